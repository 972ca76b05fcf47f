"""Cases where an operator once did less than its whole job."""

import numpy as np

from stationwatch.llm import common, embed_dedup, secrets, toxicity


def test_long_chains_are_one_component(spark):
    """Before, 60 rounds left seven labels on a shuffled chain of 1000 nodes."""
    ids = np.random.default_rng(0).permutation(1000)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, ids[1:])] + [(2000, 2001)], "a long, b long")
    found = {r.node: r.component for r in common.components(edges).collect()}
    assert found == {**dict.fromkeys(range(1000), 0), 2000: 2000, 2001: 2000}


def test_embedding_recall_in_a_crowd(spark):
    """Pairs near the least cosine inside one dense cluster of 4000 vectors; windows of fixed passes met only part of them."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=32)
    x = centre / np.linalg.norm(centre) * 2 + rng.normal(size=(4000, 32)) / 32**0.5
    x[2000:] = x[:2000] + 0.32 * np.linalg.norm(x[:2000], axis=1)[:, None] * rng.normal(size=(2000, 32)) / 32**0.5
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    truth = int((unit @ unit.T >= 0.95).sum()) - len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in embed_dedup.near_duplicate_vectors(df).collect())
    assert truth > 2000 and 0.995 * truth <= found <= truth


def test_embedding_passes_follow_the_cells():
    for bits in (1, 8, 16, 24):
        shared = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - shared) ** embed_dedup.passes_for(bits, 0.95) >= embed_dedup.RECALL


def test_keys_deep_inside_a_candidate_are_found():
    """A key after the 48th character of its candidate, and one beside a pattern's finding."""
    made, truth = secrets.generated_findings(3000)
    network = secrets.train_network(np.frombuffer(b"".join(secrets.encode(*r) for r in made), np.uint8).reshape(3000, -1), truth)
    key, path = "Zq8Xv2Lk9TbW4nRc7JfY1mHd6PsG3aKe", "/home/letters/reading/station/weather/records/daily/"
    assert len(path) > secrets.INSIDE
    deep, beside, plain = f"see {path}{key} for it", f"use AKIA{'A1B2' * 5}/{key} now", f"see {path}page12.html for it"
    found = secrets.find_all([deep, beside, plain, None], network)
    assert found[0] == [("cnn", 4, 4 + len(path) + len(key))]
    assert [s[0] for s in found[1]] == ["access", "cnn"] and found[1][1][2] == beside.index(key) + len(key)
    assert found[2] == found[3] == []


def test_telling_tokens_are_learned_behind_many_common_words(spark):
    ordinary = " ".join(f"word{k}" for k in range(30))
    rows = [(i, f"{ordinary} grunk slorp" if i % 4 == 0 and i % 12 < 8 else f"{ordinary} blech {'blech ' * 80}" if i == 4 else ordinary) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert len(model.hashes) == 2
