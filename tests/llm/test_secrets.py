"""Secrets: pattern findings against plain regular expressions, planted keys that no pattern knows, long candidates."""

import random
import re
import string
import zlib

import numpy as np
import pytest

from stationwatch.llm import secrets

ALL = string.ascii_letters + string.digits


def prose(rng, n):
    ordinary = ["".join(rng.choice("ba be di do ku th er en".split()) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    odd = ["x.42@mail9.example.com", "192.168.10.254", "2024-03-11T10:22", "see/page/index12.html", "report_final_2023.txt", "v1.22.3-beta.104", "Hauptstadtflughafen", "4111111111111111", "camelCaseName", "ISBN-978-3-16"]
    return [rng.choice(odd) if rng.random() < 0.02 else w for w in ordinary]


@pytest.fixture(scope="module")
def corpus():
    """500 documents; a quarter has a finding of the patterns, a quarter a key that no pattern knows."""
    rng = random.Random(12)
    rows, planted = [], {}
    for i in range(500):
        w = prose(rng, rng.randint(20, 300))
        if i % 4 == 1:
            w.insert(rng.randrange(len(w)), rng.choice(['token = "%s"', "password: %s", "%s"]) % "".join(rng.choice("0123456789abcdef") for _ in range(40)))
        if i % 4 == 3:
            planted[i] = rng.choice(["", "glpat-", "xoxp-"]) + "".join(rng.choice(rng.choice([ALL, ALL + "+/"])) for _ in range(rng.randint(24, 60)))
            w.insert(rng.randrange(len(w)), planted[i])
        rows.append((i, " ".join(w)))
    return rows, planted


def test_planted_keys_are_found(spark, corpus):
    rows, planted = corpus
    df = spark.createDataFrame(rows, "doc_id long, text string")
    network = secrets.fit(df, generated=2000)
    text, hit, false = dict(rows), 0, 0
    for r in secrets.scan(df, network).collect():
        own = [text[r.doc_id][s.start : s.end] for s in r.secret_spans if s.kind == "cnn"]
        hit += any(planted.get(r.doc_id, "-") in x for x in own)
        false += sum(planted.get(r.doc_id, "-") not in x for x in own)
    assert hit >= 0.95 * len(planted) and false <= 0.01 * len(rows)


def test_base_findings_match_plain_expressions(corpus):
    """The contract read off literally: leftmost matches of each kind by themselves, short ones dropped."""
    rng = random.Random(3)
    texts = [t for _, t in corpus[0]] + ["".join(rng.choice(["token", "SECRET", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef" * 3, "é", "x", "passwd", "\n", "K"]) for _ in range(40)) for _ in range(400)]
    for text in texts:
        wanted = [("assign", m.start(), m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if m.end(2) - m.start(2) >= 6]
        wanted += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
        wanted += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
        assert secrets.base_findings(text) == sorted(wanted, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_windows_cover_candidates():
    for size in range(secrets.LEAST, 400):
        seen = np.zeros(size, bool)
        for at in secrets.windows(7, 7 + size):
            assert 7 <= at
            seen[at - 7 : at - 7 + secrets.INSIDE] = True
        assert seen.all()
    text = "before " + "k1" * 60 + " after"
    last = secrets.encode(text, 7, 127, 79)
    assert last[: secrets.BEFORE] == secrets.encode(text, 7, 127)[: secrets.BEFORE] and last[-secrets.AFTER :] == secrets.encode(text, 7, 127)[-secrets.AFTER :]


def test_long_texts_and_repeated_rows(spark):
    network = secrets.train_network(np.frombuffer(b"".join(secrets.encode(*r) for r in secrets.generated_findings(600)[0]), np.uint8).reshape(600, -1), secrets.generated_findings(600)[1])
    long = "word " * 300_000 + "AKIA" + "A1B2" * 5 + " " + "9" * 300_000 + " " + "Ab1" * 100_000
    rows = [(1, long), (1, long), (2, "token=abcdef"), (2, "token=abcdef")]
    found = [r.spans for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), network)).collect()]
    assert len(found) == 4 and len(set(found)) == 2 and any(f.startswith("access:1500000:1500024") for f in found)


def test_every_window_is_dealt_and_learned_from(spark, corpus):
    """All windows of learnable documents are in the parts, once where a kind fills them; keys are found when many parts are mixed, the same ones each time."""
    df = spark.createDataFrame(corpus[0], "doc_id long, text string")
    wanted = {True: [], False: []}
    for i, text in corpus[0]:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            spans = secrets.base_findings(text)
            for start, end in secrets.values(text):
                wanted[True] += [secrets.encode(text, start, end, at) for at in secrets.windows(start, end)]
            for start, end in secrets.candidates(text):
                wanted[False] += [secrets.encode(text, a, b, at) for a, b in secrets.uncovered(text, start, end, spans) for at in secrets.windows(a, b)]
    size = 1 + max(len(w) for w in wanted.values()) // 4
    table, n = secrets.parts(df, size)
    rows, width = table.collect(), secrets.BEFORE + secrets.INSIDE + secrets.AFTER
    assert n == len(rows) == 4 and sorted(r.part for r in rows) == list(range(4))
    for kind, name in ((True, "secret"), (False, "rest")):
        found = [bytes(r[name][i : i + width]) for r in rows for i in range(0, len(r[name]), width)]
        assert set(found) == set(wanted[kind]) and len(found) >= len(wanted[kind])
        if len(wanted[kind]) > 2 * size:
            assert sorted(found) == sorted(wanted[kind])
    network, again = (secrets.fit(df, size, 1000) for _ in range(2))
    assert network.threshold == again.threshold and (network.filters == again.filters).all()
    text, hits = dict(corpus[0]), 0
    for r in secrets.scan(df, network).collect():
        hits += any(corpus[1].get(r.doc_id, "-") in text[r.doc_id][s.start : s.end] for s in r.secret_spans if s.kind == "cnn")
    assert hits >= 0.95 * len(corpus[1])
