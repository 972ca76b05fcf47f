"""Each operator against brute force on a small table, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import hashlib
import json
import random
import re
import time

import numpy as np
import pytest

from stationwatch.llm import chat, decontam, embed_dedup, html_extract, induced_sort, lang_id, mixing, near_dup, secrets, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, syllables="ba be bi bo bu da de di do du".split()):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Documents with exact and near copies, shared passages, nulls, empties and repeated rows."""
    rng = random.Random(4)
    rows, base, passage = [], [words(rng, 120) for _ in range(12)], words(rng, 140)
    for i in range(60):
        text = base[i % 12]
        if i >= 12:
            w = text.split()
            for _ in range(rng.choice([0, 1, 2, 8])):
                w[rng.randrange(len(w))] = words(rng, 1)
            text = " ".join(w)
        if i % 7 == 0:
            text = f"{text} {passage} {words(rng, 5)}"
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(text)))
    rows += [(60, None, None, None, None), (61, "", "en", "a", 0), (62, " \t\n", "en", "a", 3), (63, "one two", "de", "a", 7), (64, "ONE\ttwo", "de", "b", 7), (None, base[0], "en", "a", 1), (5, rows[5][1], rows[5][2], rows[5][3], rows[5][4])]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def least_reachable(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_near_duplicates_match_brute_force(docs, corpus, none):
    sets = {r[0]: shingles(r[1]) for r in corpus if r[0] is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = least_reachable(ids, links)
    found = near_dup.near_duplicates(docs.selectExpr("*", "1 AS rep", "2 AS key", "3 AS component")).collect()
    assert len(found) == len(corpus)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
    assert near_dup.near_duplicates(none).count() == 0


def test_signatures_within_the_threshold_meet():
    """The pigeonhole guarantee: any two signatures that differ in MAX_DIFFERENT slots share a key."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, near_dup.SLOTS)
        b = a.copy()
        b[rng.choice(near_dup.SLOTS, near_dup.MAX_DIFFERENT, replace=False)] += 1
        errors = (a != b).reshape(near_dup.CHUNKS, near_dup.WIDTH).sum(1)
        assert errors.min() <= 1


def test_families_link_across_blocks(monkeypatch, docs, corpus):
    """Small blocks give the same components as large ones."""
    wanted = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()} == wanted


def test_suffix_dedup_matches_brute_force(docs, corpus, none):
    raw = [(r[1] or "").encode() for r in corpus]
    seen = {}
    for text in raw:
        for k in range(len(text) - 399):
            seen[text[k : k + 400]] = seen.get(text[k : k + 400], 0) + 1
    wanted = []
    for row, text in zip(corpus, raw, strict=True):
        gone = np.zeros(len(text) + 1, int)
        for k in range(len(text) - 399):
            if seen[text[k : k + 400]] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        wanted.append((row[0], len(text), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
    found = suffix_dedup.digest(suffix_dedup.remove_repeats(docs.selectExpr("*", "0 AS kept", "0 AS t1"))).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, wanted))
    assert sum(w[2] for w in wanted) > 0
    assert suffix_dedup.digest(suffix_dedup.remove_repeats(none)).count() == 0


@pytest.mark.parametrize("in_memory", [8_000_000, 5])
def test_induced_sort_orders_suffixes(monkeypatch, in_memory):
    monkeypatch.setattr(induced_sort.TupleQueue.__init__, "__defaults__", (in_memory,))
    rng = random.Random(1)
    for _ in range(150):
        s = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 50))] + [0]
        assert list(induced_sort.suffix_order(np.array(s, np.int16), 8)) == sorted(range(len(s)), key=lambda i: s[i:])


def test_long_texts_go_in_pieces(spark, monkeypatch, docs, corpus):
    """Texts of many pieces lose the same bytes as whole ones."""
    rng = random.Random(2)
    long = words(rng, 3000)
    rows = [(1, long), (2, f"{words(rng, 50)} {long[4000:9000]} {words(rng, 50)}"), (3, words(rng, 900))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    wanted = sorted(map(str, map(tuple, suffix_dedup.digest(suffix_dedup.remove_repeats(df)).collect())))
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    found = suffix_dedup.digest(suffix_dedup.remove_repeats(df)).collect()
    assert sorted(map(str, map(tuple, found))) == wanted
    assert {r.doc_id: r.n_removed for r in found if r.doc_id in (2,)}[2] >= 5000


def test_bytes_decide_not_hashes(monkeypatch):
    """With a hash that calls everything equal, only equal strings count as repeats."""
    rng = random.Random(4)
    rows = [words(rng, 200).encode() for _ in range(6)]
    rows.append(rows[0][50:600])
    wanted = [list(x) for x in induced_sort.repeated_starts(rows, 400)]
    monkeypatch.setattr(induced_sort, "span_hash", lambda prefix, starts, ends: np.zeros(len(starts), np.uint64))
    monkeypatch.setattr(induced_sort, "suffix_order", lambda text, symbols: np.array(sorted(range(len(text)), key=lambda i: text[i:].tolist())))
    assert [list(x) for x in induced_sort.repeated_starts(rows, 400)] == wanted and sum(map(len, wanted)) > 0


def test_language_identification(spark, none):
    rng = random.Random(3)
    tongues = {"en": "the and of to in that is".split(), "de": "der die und in den von zu".split(), "fr": "le la et les des en un".split(), "es": "el la y los que en un".split()}
    rows = [(i, " ".join(rng.choice(tongues[lang]) for _ in range(40)), lang) for i, lang in enumerate(rng.choices(list(tongues), k=240))]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 34 !?", "en"), (None, "the and of", None)]
    found = lang_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "1 AS held_out")).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and r.doc_id < 900]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert [by_id[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert lang_id.identify(none).count() == 0
    assert {r.lang_pred for r in lang_id.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_mixing_keeps_every_source_within_a_block(docs, corpus, none):
    weights = {"a": 3, "b": 2, None: 1}
    rows = mixing.mix_sources(docs.selectExpr("*", "'x' AS slot"), weights, block_chars=500).collect()
    assert len(rows) == len(corpus)
    for source in ("a", "b", None):  # a block has one slot, in the order of the source
        own = sorted({(r.block, r.slot) for r in rows if r.source == source})
        assert [s for _, s in own] == sorted({s for _, s in own}) and len({b for b, _ in own}) == len(own)
    assert len({r.slot for r in rows}) == len({(r.source, r.block) for r in rows})
    assert mixing.mix_sources(none).count() == 0


def test_running_offsets_are_prefix_sums(monkeypatch, docs):
    monkeypatch.setattr(mixing, "PIECE_ROWS", 4)
    rows = mixing.mix_sources(docs, block_chars=500).collect()
    for source in {r.source for r in rows}:
        own = sorted((r.offset, len(r.text or "")) for r in rows if r.source == source)
        assert [o for o, _ in own] == sorted(np.concatenate([[0], np.cumsum(sorted(n for _, n in own if False) or [n for _, n in own])[:-1]]).tolist())


@pytest.mark.parametrize("hot", [False, True])
def test_embedding_links(spark, hot):
    """Hot: two clusters larger than the window, whose vectors share whole keys."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 8))
    x = [base[i % (1 if hot else 30)] + rng.normal(size=8) * (1e-4 if hot else 0.05) for i in range(150)]
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    rows += [(500, rows[3][1]), (501, None), (502, []), (503, [0.0] * 8), (504, [1.0, float("nan")] + [0.0] * 6), (505, [None] * 8), (506, [1.0, 2.0]), (None, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank")
    found = embed_dedup.near_duplicate_vectors(df).collect()
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and (i < 500 or i == 500)]
    links = [(a, b) for k, (a, u) in enumerate(good) for b, v in good[:k] if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.95]
    degree = {}
    for a, b in links:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    label = least_reachable([i for i, _ in good], links)
    assert len(found) == len(rows)
    right = sum(r.n_links for r in found if r.vec_id is not None and r.vec_id != 3), sum(n for i, n in degree.items() if i != 3)
    assert 0.9 * right[1] <= right[0] <= right[1]
    for r in found:
        if r.vec_id is None or r.vec_id > 500:
            assert r.n_links == 0 and r.component_id == r.vec_id and r.kept
        else:
            assert r.component_id == label[r.vec_id]
    assert embed_dedup.near_duplicate_vectors(df.where("false")).count() == 0


def test_decontamination(spark, none):
    rng = random.Random(8)
    items = [(i, words(rng, 60, "xa xe xi zo zu ka ke".split())) for i in range(6)] + [(6, None), (7, ""), (8, "short one"), (None, words(rng, 60))]
    clean = [(i, words(rng, 200)) for i in range(20)]
    damaged = list(items[2][1])
    for at in range(10, len(damaged), 60):
        damaged[at] = "q"
    dirty = [(100, f"{words(rng, 50)} {items[0][1]} {words(rng, 50)}"), (101, items[1][1].upper()), (102, f"{words(rng, 9)} {''.join(damaged)}"), (103, items[3][1][80:240]), (104, None), (105, ""), (100, items[4][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(clean + dirty, "doc_id long, text string").selectExpr("*", "'x' AS items")
    found = [(r.doc_id, r["items"]) for r in decontam.contamination(df, benchmark).collect()]
    assert sorted((i, tuple(x)) for i, x in found if x) == [(100, (0,)), (100, (4,)), (101, (1,)), (102, (2,)), (103, (3,))]
    assert sorted(r.doc_id for r in decontam.decontaminate(df, benchmark).collect()) == sorted([i for i, _ in clean] + [104, 105])
    assert decontam.decontaminate(none, benchmark).count() == 0
    assert decontam.decontaminate(df, benchmark.where("false")).count() == df.count()


def test_tool_calls(spark):
    tools = {"tools": [{"name": "f", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}]}
    calls = {"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": 1}}, {"id": "b", "name": "f", "arguments": {"x": "s"}}, {"id": "c", "name": "g", "arguments": {}}, {"id": "a", "name": "f", "arguments": {"x": 2}}]}
    chain = {"tool_calls": [{"id": "p", "name": "f", "arguments": {"x": {"$ref": "q"}}}, {"id": "q", "name": "f", "arguments": {}}]}
    loop = {"tool_calls": [{"id": "p", "name": "f", "arguments": {"$ref": "q"}}, {"id": "q", "name": "f", "arguments": {"$ref": "p"}}]}
    rows = [
        (1, 0, "system", json.dumps(tools)), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "R"})), (1, 2, "assistant", json.dumps(calls)), (1, 3, "tool", json.dumps({"tool_call_id": "z", "content": {"b": 1, "a": 2}})),
        (2, 0, "user", None), (None, 1, "user", "x"), (2, None, "assistant", "{bad"), (3, 0, "assistant", json.dumps(chain)), (3, 1, "tool", json.dumps({"tool_call_id": "q", "content": "Q"})),
        (3, 2, "tool", json.dumps({"tool_call_id": "p", "content": "P"})), (4, 0, "assistant", json.dumps(loop)), (4, 1, "tool", json.dumps({"tool_call_id": "p", "content": ""})), (4, 2, "tool", json.dumps({"tool_call_id": "q", "content": ""})),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS kind")
    found = chat.link(df).collect()
    status = {(r.conv_id, r.turn, r.part): r.status for r in found}
    assert [status[1, 2, i] for i in range(4)] == ["linked", "invalid $.x: type", "unknown tool", "duplicate"]
    assert status[1, 1, 0] == "linked" and status[1, 3, 0] == "orphan"
    order = [(r.turn, r.part) for r in sorted((r for r in found if r.conv_id == 3), key=lambda r: r.place)]
    assert order == [(0, 1), (1, 0), (0, 0), (2, 0)]
    assert json.loads(next(r.message for r in found if r.conv_id == 1 and r.turn == 3))["content"] == '{"a":2,"b":1}'
    assert [r.status for r in found if r.conv_id == 4 and r.kind == "call"] == ["cyclic"] * 2 and len([r for r in found if r.conv_id == 4]) == 4
    assert chat.link(df.where("false")).count() == 0 and chat.link(df.where("conv_id = 2")).count() == 2


def test_toxicity(spark, none):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        w = words(rng, 60).split()
        toxic = i % 4 == 0
        for _ in range(6 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grunk", "slorp", "blech"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (None, "grunk slorp blech grunk slorp")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score")
    labelled = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
    found = toxicity.score(df, toxicity.fit(df, labelled)).collect()
    held = [r for r in found if r.held_out and r.doc_id < 400]
    assert sum((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found) and next(r for r in found if r.doc_id is None).score > 0.3 and next(r for r in found if r.doc_id == 0).passages
    model = toxicity.fit(none, labelled)
    assert {r.score for r in toxicity.score(df, model).collect()} == {0.0} and toxicity.score(none, model).count() == 0


def test_segments_are_all_maximal():
    """The linear scan against the definition: greedy removal of the best segment, over and over."""
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 12)
        at = np.array(sorted(rng.sample(range(20), n)))
        gain = np.array([rng.choice([0.53, 1.01, 2.07]) + rng.random() / 50 for _ in range(n)])
        scores = np.full(20, -0.37)
        scores[at] = gain

        def best(low, high):
            spans = [(sum(scores[a : b + 1]), -(b - a), a, b) for a in range(low, high) for b in range(a, high)]
            top = max(spans, default=(0, 0, 0, 0))
            return [] if top[0] <= 1e-12 else [*best(low, top[2]), (top[2], top[3], round(top[0], 6)), *best(top[3] + 1, high)]

        assert [(a, b, round(s, 6)) for a, b, s in toxicity.segments(at, gain, -0.37)] == sorted(best(0, 20))


def test_segment_scan_is_linear():
    """Twice the hits, about twice the time, and many at once."""
    for gain in (0.5 + np.random.default_rng(1).random(200_000), np.linspace(2, 0.1, 200_000), np.linspace(0.1, 2, 200_000)):
        for gap in (1, 9, 40):
            began = time.process_time()
            toxicity.segments(np.arange(200_000) * gap, gain)
            assert time.process_time() - began < 2


def test_extreme_values_match_counts():
    """Best scores drawn from the law itself give its size back, and ``expected`` tells how many texts exceed a score."""
    rng = np.random.default_rng(2)
    length = rng.integers(20, 2000, 20_000).astype(float)
    best = (np.log(0.02 * length) - np.log(-np.log(rng.random(20_000)))) / 0.8
    best = np.where(best < 1.5, 0, best)  # no segment is smaller than the least gain
    model = toxicity.ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.8, toxicity.extreme_size(best, length, 0.8, 1.5))
    assert 0.019 < model.size < 0.021
    for level in (8.0, 10.0, 12.0):
        wanted = sum(1 - np.exp(-model.expected(level, int(n))) for n in length)
        assert 0.85 * wanted < (best >= level).sum() < 1.15 * wanted


def test_html_extraction(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(words(rng, 12).capitalize() + "." for _ in range(n))
    pages, wanted = [], {}
    for i in range(60):
        title, a, b = text(1), text(4), text(3)
        pages.append((i, "u", f"<html><head><title>{title}</title><style>x</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>{title}</h1><p>{a}<br>x&amp;y&nbsp;&lt;<p><b>{b}</p><script>no</script></article><footer>&copy; me</footer></body></html>"))
        wanted[i] = f"{title} {a} x&y < {b}"
    other = f"<body><div class='site-header'>Top</div><div class='menu'><a href='/'>A</a></div><div class='post-body'><p>{text(4)}</p><p>{text(5)}</p></div><div class='comments'><p>{text(1)}</p></div><div class='footer'>Bye</div></body>"
    pages += [(100, None, None), (101, "u", ""), (102, "u", "<p"), (None, None, pages[0][2]), (103, "u", other)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    field = html_extract.fit(df, sample=40, made=300)
    found = html_extract.extract(df, field).collect()
    assert len(found) == len(pages)
    by_id = {r.page_id: r.text for r in found}
    assert sum(by_id[i] == t for i, t in wanted.items()) >= 58
    assert by_id[100] == by_id[101] == ""
    assert "Top" not in by_id[103] and "Bye" not in by_id[103] and len(by_id[103]) > 200
    assert html_extract.extract(df.where("false"), field).count() == 0


def test_field_learns_unseen_layouts():
    sentences = [words(random.Random(i), 9).capitalize() + "." for i in range(200)]
    field = html_extract.train_field(html_extract.made_pages(sentences, 250, seed=1), epochs=8)
    pages = html_extract.made_pages(sentences, 60, seed=2)
    right = np.concatenate([field.decode(b) == np.array(y) for b, y in pages])
    assert right.mean() > 0.97


def test_secret_scan(spark, none):
    key = "f3a9" * 10
    rows = [(1, f'x token = "{key}" y'), (2, "AKIA" + "A1B2" * 5), (3, "PassWord: abc"), (4, "api-key"), (5, None), (6, ""), (None, f"é secret={key[:8]}"), (7, "plain words only " * 20), (8, "password=ſecret1 apiKey:'abcdef.gh'")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS secret_spans")
    network = secrets.train_network(np.frombuffer(b"".join(secrets.encode(*r) for r in secrets.generated_findings(600)[0]), np.uint8).reshape(600, -1), secrets.generated_findings(600)[1])
    found = {r.doc_id: r for r in secrets.digest(secrets.scan(df, network)).collect()}
    assert (found[1].n_assign, found[1].n_hex, found[2].n_access, found[3].n_assign) == (1, 1, 1, 0)
    assert found[1].spans == "assign:2:51,hex:11:51" and found[1].base_sha256 == hashlib.sha256(b"assign:2:51,hex:11:51").hexdigest()
    assert found[None].spans.startswith("assign:2:17") and found[5].spans == found[6].spans == found[7].spans == ""
    assert found[8].n_assign == 1
    clean = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string"), network=network).collect()}
    assert clean[1] == 'x [SECRET]" y' and clean[5] is None and clean[7] == rows[7][1]
    assert secrets.digest(secrets.scan(none, network)).count() == 0
    texts, truth = secrets.generated_findings(400, seed=99)
    p = network.probability(np.frombuffer(b"".join(secrets.encode(*r) for r in texts), np.uint8).reshape(400, -1))
    assert (p[truth] >= network.threshold).mean() >= 0.95 and (p[~truth] >= network.threshold).mean() <= 0.1


def test_pipeline_stages_keep_columns(spark, tmp_path, docs):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words(random.Random(99), 60, "xa xe xi".split()))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        before = rows.columns
        rows = function(spark, rows, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or rows.columns == before
    assert rows.count() > 0


def test_pipeline_keeps_own_columns_and_reads_empty_tables(spark, tmp_path, docs, none):
    """Columns named like a stage's results come back as they were; an empty table goes through all stages."""
    import corpus_pipeline

    spark.createDataFrame([(1, words(random.Random(99), 60, "xa xe xi".split()))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = {"held_out": "own", "score": "7", "lang_pred": "x", "items": "y", "secret_spans": "z", "kept": "k"}
    for rows in (docs.selectExpr("*", *(f"'{v}' AS {c}" for c, v in own.items())), none):
        before = rows.columns
        for _, function in corpus_pipeline.STAGES[:-1]:
            rows = function(spark, rows, str(tmp_path))
            assert rows.columns == before
        found = rows.collect()
        assert all(r[c] == v for r in found for c, v in own.items() if c in before)
    assert not found and corpus_pipeline.mix_sources(spark, rows, str(tmp_path)).count() == 0


def test_one_id_with_two_texts_keeps_the_same_row(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    rows = [(1, words(rng, 80), "en", "a", 1), (1, words(rng, 80), "en", "b", 2), (2, words(rng, 80), "en", "a", 3), (None, "x", "en", "a", 4), (None, "x", "en", "a", 4)]
    kept = [sorted((str(r.doc_id), r.n_chars) for r in corpus_pipeline.remove_near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(n), "").collect()) for n in (1, 4)]
    assert kept[0] == kept[1] and len(kept[0]) == 4
