"""The schedule: every source less than one block from its exact target after every slot, in chunks that know nothing of each other."""

from fractions import Fraction

import numpy as np
import pytest

from stationwatch.llm import mixing


def laid_out(plan):
    return sorted((slot, s, block) for phase in plan for c in range(phase.chunks()) for s, block, slot in phase.schedule(c))


@pytest.mark.parametrize("chunk", [1, 7, 64, 4096])
@pytest.mark.parametrize("weights", [
    {"a": 1, "b": 1, "c": 1}, {"a": 2**0.5, "b": 3**0.5, "c": 0.0004, "d": 5}, {f"s{i}": 1 / (i + 1) for i in range(40)}, {"a": Fraction(1, 3), "b": Fraction(2, 3)},
    {"big": 0.9, **{f"t{i}": 0.001 * (i + 1) for i in range(30)}},
])
def test_deviation_stays_below_one_block(monkeypatch, chunk, weights):
    """Over thousands of slots, against the weights themselves."""
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    total = sum(Fraction(w) for w in weights.values())
    n = 6000
    plan = mixing.phases({s: int(Fraction(w) / total * n) + 2 for s, w in weights.items()}, weights)
    slots = laid_out(plan)
    assert [slot for slot, _, _ in slots] == list(range(len(slots)))
    phase = plan[0]
    names = sorted(weights)
    counts = np.zeros((phase.length + 1, len(names)), int)
    for slot, s, _ in slots[: phase.length]:
        counts[slot + 1, names.index(s)] = 1
    counts = counts.cumsum(0)
    for k, s in enumerate(names):
        w = Fraction(weights[s]) / total
        assert all(abs(int(counts[t, k]) - t * w) < 1 for t in range(0, phase.length + 1, 1 if chunk == 64 else 13))
    done = {}
    for _, s, block in slots:  # all blocks, in order
        assert block == done.get(s, 0)
        done[s] = block + 1
    assert done == {s: int(Fraction(w) / total * n) + 2 for s, w in weights.items()}


def test_every_phase_is_exact():
    """Sources of very different lengths: as each is used up, the rest keep their proportions."""
    rng = np.random.default_rng(4)
    weights = {f"s{i}": float(rng.random() + 0.01) for i in range(12)}
    blocks = {s: int(rng.integers(1, 400)) for s in weights}
    plan = mixing.phases(blocks, weights)
    slots = laid_out(plan)
    assert sorted((s, b) for _, s, b in slots) == sorted((s, b) for s, n in blocks.items() for b in range(n))
    for phase in plan:
        total = sum(Fraction(weights[s]) for s in phase.parts) if len(phase.parts) > 1 else None
        seen = dict.fromkeys(phase.parts, 0)
        for t, (_, s, _) in enumerate(slots[phase.start : phase.start + phase.length], 1):
            seen[s] += 1
            assert total is None or all(abs(seen[s] - t * Fraction(weights[s]) / total) < 1 for s in seen)


def test_query_rows_keep_the_targets(spark):
    """Rows of the operator itself: many blocks a source, distance from the target by slot."""
    rows = [(i, "x" * (20 + i % 13), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    weights = {f"s{k}": k + 0.5 for k in range(7)}
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, block_chars=200).collect()
    by_slot = {r.slot: r.source for r in found}
    last = min(max(r.slot for r in found if r.source == s) for s in weights)  # the first source to end
    count, missing, total = dict.fromkeys(weights, 0), 0, sum(weights.values())
    for t in range(last):
        missing += t not in by_slot  # a block in which no document begins
        count[by_slot.get(t, "s0")] += t in by_slot
        assert all(abs(count[s] - t * w / total) < 2 + missing for s, w in weights.items())
    assert missing == 0
