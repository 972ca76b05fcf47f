"""Phrases, repetition and clusters against brute force, and on nulls, empty and repeated rows, ties, long texts, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stationwatch.llm import clusters, phrases, quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --------------------------------------------------------------------- phrases


def brute_phrases(rows, support=phrases.SUPPORT, top=phrases.TOP):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k) > 2 and a >= support}
    out = []
    for lang in n:
        kept = []
        for key, a in found.items():
            words = key[1:]
            if key[0] != lang:
                continue
            inside = any(len(o) > len(key) and o[0] == lang and any(o[1 + i : 1 + i + len(words)] == words for i in range(len(o) - len(words))) and 100 * b >= 80 * a for o, b in found.items())
            if not inside:
                s, _, left, right = min((2000000 * a // (f[lang, *words[:k]] + f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words)))
                kept.append((-s, -a, " ".join(words).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    """Few words, many repetitions, one language with two thirds of all, odd white space, and the pieces' marks."""
    rng = random.Random(11)
    names = "Ab ba Éa é# do of the A·b x".split()
    rows = []
    for i in range(900):
        w = []
        for _ in range(rng.randint(0, 30)):
            w += rng.choice([["of", "the"], ["New", "york", "City"], [rng.choice(names)], [rng.choice(names)]])
            w.append(rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " ! "]))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(x if x.isspace() or x in ".,!" else x + " " for x in w)))
    return rows + [("fr", None), ("fr", ""), (None, " \t.\n"), ("en", rows[0][1]), ("en", rows[0][1])]


def test_phrases_match_brute_force(spark, talk, monkeypatch):
    wanted = brute_phrases(talk)
    assert len(wanted) > 60 and {r[0] for r in wanted} == {"en", "de", "und"}
    df = spark.createDataFrame([(*r, 1, "k") for r in talk], "lang string, text string, n long, phrase string").repartition(7)
    found = lambda: sorted(tuple(r) for r in phrases.collocations(df).collect())
    assert found() == wanted
    monkeypatch.setattr(phrases, "PHRASE_BITS", 8)  # crowded tables of bits hold nothing back
    monkeypatch.setattr(phrases, "WORD_BITS", 7)
    assert found() == wanted
    assert phrases.collocations(df.where("false")).count() == 0


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_long_texts_are_cut_between_pieces(talk, monkeypatch, size):
    monkeypatch.setattr(phrases, "SLICE_BYTES", size)
    batch = pa.RecordBatch.from_pydict({"lang": pa.array([r[0] or "und" for r in talk], pa.string()), "text": pa.array([r[1] for r in talk], pa.string())})
    found = Counter()
    for _, words, known in phrases._texts(iter([batch])):
        for k in range(1, 5):
            at, _, n = words.counted(phrases.Passed().places(words, k), k)
            for name, phrase, count in zip(phrases._named(known, words, at).to_pylist(), words.phrases(at, k).to_pylist(), n.tolist(), strict=True):
                found[name, phrase] += count
    wanted = Counter()
    for lang, text in talk:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            wanted.update((lang or "und", " ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert found == wanted


@pytest.mark.parametrize("held", [1 << 21, 40])
def test_keys_are_counted_through_blocks_and_merges(spark, talk, monkeypatch, held):
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << phrases.KEY_BITS, 3000, dtype=np.uint64)
    keys = np.concatenate([keys, keys[:900], [0, (1 << phrases.KEY_BITS) - 1]]).astype(np.uint64)
    names, n = phrases._added([(keys[:2000], np.ones(2000, np.int64)), (keys[2000:], np.ones(len(keys) - 2000, np.int64))])
    assert dict(zip(names.tolist(), n.tolist(), strict=True)) == dict(Counter(keys.tolist()))
    blocks = phrases._blocks(names, n, 5, 3).to_pydict()
    back = [phrases._unpacked(b) for b in blocks["block"]]
    assert np.array_equal(np.concatenate([k for k, _ in back]), names) and np.array_equal(np.concatenate([c for _, c in back]), n)
    assert all((k >> np.uint64(phrases.KEY_BITS - 5) == r).all() for (k, _), r in zip(back, blocks["range"], strict=True)) and set(blocks["shard"]) == {3}
    assert phrases._blocks(names[:0], n[:0], 5, 0).num_rows == 0
    monkeypatch.setattr(phrases, "HELD_KEYS", held)  # tasks send often and merges go in many steps
    df = spark.createDataFrame(talk, "lang string, text string").repartition(5)
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == brute_phrases(talk)


def test_phrases_are_cut_at_the_first_of_equals_and_ranked_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TOP", 3)
    rows = [("en", t) for t in ("z q. z q", "a b; é b", "é c! zz c") for _ in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert [tuple(r) for r in phrases.collocations(df).orderBy("rank").collect()] == brute_phrases(rows, top=3)


def test_supports_add_up_whatever_the_shards(spark, talk, monkeypatch):
    for shards in (1, 3, 50):
        monkeypatch.setattr(phrases, "SHARDS", shards)
        df = spark.createDataFrame(talk, "lang string, text string").repartition(12)
        assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == brute_phrases(talk)


def test_scores_are_exact_beyond_64_bits(spark):
    a = 7_000_000_000_000_000
    counts = spark.createDataFrame([("en", "", 0, 9 * a), ("en", "x y", 2, a), ("en", "x", 1, a + 1), ("en", "y", 1, a + 2)], "lang string, phrase string, size int, a long")
    assert phrases.scored(counts).first().score == 2000000 * a // (2 * a + 3)


# --------------------------------------------------------------------- quality


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)

    def repeated(k):
        at = {}
        for i in range(len(w) - k + 1):
            at.setdefault(tuple(w[i : i + k]), []).append(i)
        return {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + k)}

    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows, covered = len(repeated(8)), repeated(quality.REPEAT)
    longest = next((k for k in range(len(w), quality.REPEAT - 1, -1) if repeated(k)), 0) if covered else 0
    failed = len(w) < 20 or 100 * windows > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, windows, failed, not failed and 100 * len(covered) <= 50 * len(w) and longest <= quality.LONGEST, covered, longest


def _repetitive(rng, n):
    words = "so it goes on & on é ß #1 <b> the end".split()
    out = []
    while len(out) < n:
        if out and rng.random() < 0.15:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randint(1, 30)]
        else:
            out.append(rng.choice(words) + (str(rng.randrange(200)) if rng.random() < 0.8 else ""))
    return "".join(x + rng.choice([" ", " ", "\n", "\t ", "\r\n"]) for x in out)


def test_quality_matches_brute_force(spark):
    rng = random.Random(12)
    texts = [None, "", " \n\t", "one", "a " * 30, "This This This This This " + "that that that that that " * 4, *(_repetitive(rng, rng.randint(0, 250)) for _ in range(120))]
    half = " ".join(f"w{i}" for i in range(210))
    texts += [f"{half} {' '.join(f'v{i}' for i in range(1500))} {half}", texts[8], "line\nline\n \n \nline \n" * 5]  # one long repeat, a repeated row
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, repeats string").repartition(3)
    rows = {r.doc_id: r for r in quality.assess(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        *wanted, covered, longest = brute_quality(t)
        r = rows[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept] == wanted
        assert {j for s in r.repeats for j in range(s.start, s.end)} == covered and r.n_covered_words == len(covered) and r.longest_repeat == longest
    assert not rows[len(texts) - 3].base_failed and not rows[len(texts) - 3].kept  # only the long repeat tells
    assert not rows[5].base_failed or not rows[5].kept
    assert quality.assess(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_arrays_prefixes_and_maximal_repeats(values):
    s = np.array(values)
    order, levels = quality.suffix_array(s)
    assert order.tolist() == sorted(range(len(values)), key=lambda i: values[i:])
    prefixes = quality.common_prefixes(order, levels)
    for k in range(1, len(values)):
        a, b = values[order[k - 1] :], values[order[k] :]
        assert prefixes[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    subs = {tuple(values[i:j]) for i in range(len(values)) for j in range(i + 2, len(values) + 1)}
    wanted = {}
    for sub in subs:
        at = [i for i in range(len(values)) if tuple(values[i : i + len(sub)]) == sub]
        sides = lambda k: {values[i + k] if 0 <= i + k < len(values) else (i,) for i in at}  # noqa: E731, B023
        if len(at) > 1 and len(sides(-1)) > 1 and len(sides(len(sub))) > 1:
            wanted[sub] = at
    found = {tuple(values[order[a] : order[a] + n]): sorted(order[a : b + 1].tolist()) for n, a, b in quality.maximal_repeats(s, order, prefixes, 2)}
    assert found == wanted


def test_long_texts_take_time_in_proportion():
    text = np.frombuffer(b"again and " * 200_000, np.uint8)
    found = quality.measure(text, np.array([0, len(text)]))
    assert found["longest_repeat"][0] == 399_998 and found["n_covered_words"][0] == 400_000


# -------------------------------------------------------------------- clusters


def brute_clusters(rows, count, rounds=clusters.ROUNDS):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:count]]
    far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))[::-1]
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(far(v)[0], []).append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centroids)]
    out = [(i, *far(v)) for i, v in kept]
    sums = Counter()
    for _, k, d in out:
        sums[k] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, sums[k], sum(sums.values()), names[k]) for i, k, d in out), key=str)


def _embeddings(n, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (scale * rng.normal(size=64)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("scale", "count"), [(0.2, 7), (300.0, 40), (1e5, 5), (1e9, 4)])
def test_clusters_match_brute_force(spark, scale, count):
    rows = _embeddings(90, 1, scale)
    rows += [(200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65), (204, [None] + [0.5] * 63), (205, [float("nan")] * 64), (206, [float("inf")] + [0.0] * 63), (207, [0.0] * 64), (3, rows[3][1]), (None, rows[4][1]), (5, rows[6][1])]
    df = spark.createDataFrame([(*r, "c", 9) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    found = sorted((tuple(r) for r in clusters.cluster(df, count).collect()), key=str)
    wanted = [tuple(None if isinstance(x, int) and x >= 1 << 63 else x for x in r) for r in brute_clusters(rows, count)]
    assert found == sorted(wanted, key=str)
    assert clusters.cluster(df.where("vec_id = 200")).count() == 0


def test_equal_vectors_go_to_the_smaller_number(spark):
    rows = [(i, [1.0 * (i // 30)] * 64) for i in range(60)]
    found = clusters.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, found)) == sorted(brute_clusters(rows, 40))


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 27), st.integers(1, 27), st.integers(0, 1 << 30))
def test_planes_give_exact_products(bits_a, bits_b, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(1 << bits_a), 1 << bits_a, (3, 64)), rng.integers(-(1 << bits_b), 1 << bits_b, (2, 64))
    assert (clusters.values_of(clusters.planes_of(a)) == a).all()
    if bits_a + bits_b < 50:
        assert (clusters.dot_products(clusters.planes_of(a), clusters.planes_of(b)) == a @ b.T).all()


@pytest.mark.parametrize("name", ["op11_phrase_mining", "op12_quality_rules", "op13_centroid_clustering"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    found = queries.queries()[name](spark, "/root/testdata/sf0.001")
    wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
