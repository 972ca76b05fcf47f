"""Secret scanning: fixed patterns, and a character network over every other candidate.

The patterns give base findings, which always stay. Every further token that
could be a secret (LEAST characters or more of the secret alphabet, with a digit
and a letter or with letters of mixed case) is judged with its surroundings by a
small convolutional network in numpy. Nobody labels what no pattern covers, so
the network learns from findings whose tell-tale context is taken away: the
values that patterns found in documents that may be learned from, half of them
with the surroundings of other tokens, and generated keys. Tokens that no
pattern covers are unlabelled, not clean: of each half, what a network that
learned from the other half takes for as secret as findings held back from it is
left out when the final one learns. Its probability is calibrated
and its threshold is the highest that keeps the wanted recall on findings held
back from training.

All windows of the learnable documents are learned from or held back. They are
dealt at random into parts of a fixed size, whose number grows with the corpus;
in each round a task trains the shared network on a part, and the means of all
parts' networks are the next shared one (iterative parameter mixing). Held-back
windows of all parts are counted by cells of their score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import may_learn_from, slices, stage

# The kinds in the order of ties, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Characters that a candidate has at least.
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
_DIGIT, _LETTER, _MIXED_CASE = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("[a-z][A-Z]")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[str, int, int]


def base_findings(text: str) -> list[Span]:
    """Pattern findings as (kind, start, end) in code points, by start and then kind."""
    found: list[Span] = []
    lowered = text.lower()
    if any(word in lowered for word in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens that are long enough to hold a key and are neither numbers nor plain words."""
    return [m.span() for m in CANDIDATE.finditer(text) if _LETTER.search(m[0]) and (_DIGIT.search(m[0]) or _MIXED_CASE.search(m[0]))]


def values(text: str) -> list[tuple[int, int]]:
    """What the patterns found, without the words that gave it away."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN] if any(word in text.lower() for word in _KEYWORDS) else []
    return sorted({(a, b) for a, b in [*found, *((a, b) for kind, a, b in base_findings(text) if kind != "assign")] if b - a >= LEAST})


# --------------------------------------------------------------------- network

#: Characters before the candidate, of it, and after it that a window holds.
BEFORE, INSIDE, AFTER = 24, 48, 16
_CLASSES = 20


def _char_class(code: int) -> int:
    c = chr(code)
    groups = ("0123456789", "abcdef", "ghijklm", "nopqrstuvwxyz", "ABCDEF", "GHIJKLM", "NOPQRSTUVWXYZ", " ", "\n\r\t", "\"'", ":", "=", "+/", "_", "-", ".", "@", "#*$%&")
    return next((k for k, group in enumerate(groups, 1) if c in group), _CLASSES - 1)


_TABLE = np.array([_char_class(i) for i in range(128)], np.int8)


def encode(text: str, start: int, end: int, at: int | None = None) -> bytes:
    """One window of a candidate: BEFORE characters before it, INSIDE of its own from ``at`` on, AFTER behind it; classes as bytes, 0 for padding."""
    at = start if at is None else at
    left, own, right = text[max(0, start - BEFORE) : start], text[at : min(end, at + INSIDE)], text[end : end + AFTER]
    code = np.zeros(BEFORE + INSIDE + AFTER, np.uint8)
    for place, part, mark in ((BEFORE - len(left), left, 32), (BEFORE, own, 0), (BEFORE + INSIDE, right, 32)):
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        code[place : place + len(points)] = np.where(points < 128, _TABLE[np.minimum(points, 127)], _CLASSES - 1) | mark  # surroundings are told from the candidate
    return code.tobytes()


#: Windows of a candidate longer than INSIDE start so far apart; the last one ends with it.
STRIDE = 24


def windows(start: int, end: int) -> list[int]:
    """Where the windows of a candidate start: overlapping ones over its whole length."""
    return [start] if end - start <= INSIDE else [*range(start, end - INSIDE, STRIDE), end - INSIDE]


def uncovered(text: str, start: int, end: int, spans: list[Span]) -> list[tuple[int, int]]:
    """What the spans leave of a candidate, where that could hold a key itself."""
    out, at = [], start
    for _, a, b in [*sorted((s for s in spans if s[1] < end and start < s[2]), key=lambda s: s[1]), ("", end, end)]:
        out += [(at + x, at + y) for x, y in candidates(text[at : max(a, at)])]
        at = max(at, b)
    return out


@dataclass
class Network:
    """One convolution of width 5 over character classes, maxima over each side and the candidate, its mean, one logistic unit."""

    embed: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    WIDTH = 5
    #: Convolution places that lie within the side before, the candidate and the side after.
    PARTS = (slice(0, BEFORE - WIDTH + 1), slice(BEFORE, BEFORE + INSIDE - WIDTH + 1), slice(BEFORE + INSIDE, BEFORE + INSIDE + AFTER - WIDTH + 1))

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        x = self.embed[codes]
        n, length, _ = x.shape
        view = np.lib.stride_tricks.sliding_window_view(x, self.WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - self.WIDTH + 1, -1)
        act = view @ self.filters + self.offset
        where = np.concatenate([part.start + act[:, part].argmax(1) for part in self.PARTS], 1)
        top = np.concatenate([*(act[:, part].max(1) for part in self.PARTS), np.maximum(act[:, self.PARTS[1]], 0).mean(1)], 1)
        hidden = np.maximum(top, 0)
        return view, act, where, top, hidden, hidden @ self.out + self.bias

    def logits(self, codes: np.ndarray) -> np.ndarray:
        out = [self.forward(codes[i : i + 256])[-1] for i in range(0, len(codes), 256)]
        return np.concatenate(out) if out else np.zeros(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.shift, -30, 30)))


_ARRAYS = ("embed", "filters", "offset", "out")
#: Networks travel as whole multiples of this, so that their sums don't hang on the order of parts.
_UNIT = 2.0**-32


@dataclass
class Training:
    """A network in training, Adam's moments of its arrays, and the steps so far."""

    network: Network
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    steps: float = 0.0

    @staticmethod
    def start(rng: np.random.Generator, filters: int = 16) -> Training:
        classes, width, dim = 64, Network.WIDTH, 12
        net = Network(
            rng.normal(0, 0.5, (classes, dim)), rng.normal(0, (1 / (width * dim)) ** 0.5, (width * dim, filters)), np.zeros(filters), rng.normal(0, 0.2, 4 * filters), 0.0,
        )
        return Training(net, {k: np.zeros_like(getattr(net, k)) for k in _ARRAYS}, {k: np.zeros_like(getattr(net, k)) for k in _ARRAYS})

    def learn_from(self, codes: np.ndarray, truth: np.ndarray) -> None:
        """Adam on the logistic loss, 64 rows a step in the given order."""
        net, own = self.network, Network.PARTS[1]
        classes, dim = net.embed.shape
        width, filters = Network.WIDTH, len(net.offset)
        for i in range(0, len(codes), 64):
            x, y = codes[i : i + 64], truth[i : i + 64].astype(float)
            view, act, where, top, hidden, logit = net.forward(x)
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(x)
            d_top = np.outer(g, net.out) * (top > 0)
            d_act = np.zeros_like(act)
            for part in range(3):
                one = slice(part * filters, (part + 1) * filters)
                np.add.at(d_act, (np.arange(len(x))[:, None], where[:, one], np.arange(filters)), d_top[:, one])
            d_act[:, own] += (np.outer(g, net.out[3 * filters :])[:, None, :] / (own.stop - own.start)) * (act[:, own] > 0)
            d_view = (d_act @ net.filters.T).reshape(len(x), -1, width, dim)
            d_x = np.zeros((*x.shape, dim))
            for k in range(width):
                d_x[:, k : k + d_view.shape[1]] += d_view[:, :, k]
            d_embed = np.eye(classes)[x.reshape(-1)].T @ d_x.reshape(-1, dim)
            grads = {"embed": d_embed, "filters": view.reshape(-1, view.shape[-1]).T @ d_act.reshape(-1, filters), "offset": d_act.sum((0, 1)), "out": hidden.T @ g}
            self.steps += 1
            for name, grad in grads.items():
                self.first[name] = 0.9 * self.first[name] + 0.1 * grad
                self.second[name] = 0.999 * self.second[name] + 0.001 * grad**2
                setattr(net, name, getattr(net, name) - 0.01 * (self.first[name] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[name] / (1 - 0.999**self.steps)) + 1e-8))
            net.bias -= 0.01 * float(g.sum())

    def packed(self) -> np.ndarray:
        """All of it as whole numbers, whose means over parts are the mixed training; second moments by their roots."""
        parts = [getattr(self.network, k) for k in _ARRAYS] + [self.first[k] for k in _ARRAYS] + [np.sqrt(self.second[k]) for k in _ARRAYS]
        flat = np.concatenate([*(x.reshape(-1) for x in parts), [self.network.bias, self.steps]])
        return np.rint(flat / _UNIT).astype(np.int64)

    def unpacked(self, flat: np.ndarray) -> Training:
        """Another training of this one's shape."""
        at, parts = 0, []
        for k in _ARRAYS * 3:
            like = getattr(self.network, k)
            parts.append(flat[at : at + like.size].reshape(like.shape))
            at += like.size
        n = len(_ARRAYS)
        return Training(Network(*parts[:n], float(flat[-2])), dict(zip(_ARRAYS, parts[n : 2 * n], strict=True)), dict(zip(_ARRAYS, (x**2 for x in parts[2 * n :]), strict=True)), float(flat[-1]))


def settle(net: Network, logit: np.ndarray, truth: np.ndarray, times: np.ndarray, recall: float) -> Network:
    """Set the calibration and the highest threshold with the wanted recall, from the logits of rows held back and how often each is there."""
    share = times / max(times.sum(), 1)
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(net.slope * logit + net.shift, -30, 30)))
        net.slope, net.shift = max(0.05, net.slope - 0.3 * float(((p - truth) * logit * share).sum())), net.shift - 0.3 * float(((p - truth) * share).sum())
    order = np.argsort(logit[truth], kind="stable")
    found, count = logit[truth][order], np.cumsum(times[truth][order])
    if len(found):
        least = found[np.searchsorted(count, int((1 - recall) * count[-1] + 1e-9), "right")]
        net.threshold = float(1 / (1 + np.exp(-np.clip(net.slope * least + net.shift, -30, 30)))) - 1e-9
    return net


def train_network(codes: np.ndarray, truth: np.ndarray, recall: float = 0.99, filters: int = 16, epochs: int = 10, seed: int = 7) -> Network:
    """One network of rows at hand; every fifth row only sets the calibration and the threshold."""
    rng = np.random.default_rng(seed)
    training = Training.start(rng, filters)
    hold = held_back(len(codes))
    fit, hold = np.flatnonzero(~hold), np.flatnonzero(hold)
    for _ in range(epochs):
        fit = rng.permutation(fit)
        training.learn_from(codes[fit], truth[fit])
    return settle(training.network, training.network.logits(codes[hold]), truth[hold], np.ones(len(hold)), recall)


def held_back(n: int) -> np.ndarray:
    """True for the rows that a network of n rows isn't trained on."""
    return np.arange(n) % 5 == 4


# ------------------------------------------------------------ labelled findings

_ALPHABETS = {
    "hex": "0123456789abcdef", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def generated_findings(n: int, seed: int = 11) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """n labelled candidates in short contexts: random keys, and look-alikes such as file names, versions, dates and slugs."""
    rng = np.random.default_rng(seed)
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    letters = "etaoinshrdlucmfwypvbgk"
    word = lambda low=3, high=9: "".join(pick(letters) for _ in range(int(rng.integers(low, high))))
    rows, truth = [], []
    for i in range(n):
        secret = i % 2 == 0
        if secret:
            token = "".join(rng.choice(list(_ALPHABETS[pick(tuple(_ALPHABETS))]), int(rng.integers(20, 64))))
            token = pick(("", "", "", "sk-", "ghp_", "xoxb-", "AKIA", "key-")) + token
            lead = pick(("key: ", "credential: ", "auth ", "bearer ", 'private = "', f"{word()} ", f"{word()} {word()} ", f"{word()} {word()} "))
        else:
            digits = lambda k: "".join(str(int(rng.integers(10))) for _ in range(k))
            kind = int(rng.integers(10))
            token = (
                f"{word()}-{word()}-{word()}-{digits(2)}" if kind == 0 else f"{word()}.{word()}{digits(1)}.example.com" if kind == 1
                else f"{word()}_{word()}_{digits(4)}.txt" if kind == 2 else f"20{digits(2)}-0{digits(1)}-1{digits(1)}T1{digits(1)}.{digits(2)}" if kind == 3
                else f"/{word()}/{word()}/{word()}{digits(2)}.html" if kind == 4 else f"{word(8, 14)}{word(5, 9)}{digits(2)}" if kind == 5
                else f"v{digits(1)}.{digits(2)}.{digits(1)}-{word()}.{digits(3)}" if kind == 6 else f"{word()}{word().capitalize()}{word().capitalize()}" if kind == 7
                else f"{word()}={digits(3)}/{word()}={digits(2)}" if kind == 8 else f"{word().upper()}-{digits(4)}-{word().upper()}_{digits(2)}"
            )
            lead = f"{word()} {pick(('', word() + ' ', 'on ', 'see ', 'page '))}"
        token = token if len(token) >= LEAST else token + word(LEAST, LEAST + 1)
        words = lambda: " ".join(word(2) for _ in range(int(rng.integers(0, 9))))
        text = f"{words()} {lead}{token}{pick((' ', '. ', chr(34), chr(10)))}{words()}"
        start = text.index(token)
        rows.append((text, start, start + len(token)))
        truth.append(secret)
    return rows, np.array(truth, bool)


#: Held-back windows are counted by such cells of a network's logit.
CELL = 1 / 256
#: A judge keeps this recall on held-back findings: at up to 500 all of them; of more, single odd ones don't make everything look secret.
JUDGE_RECALL = 0.998
#: The second judges learn from what the first took for clean.
JUDGE_PASSES, JUDGE_ROUNDS, ROUNDS = 2, 4, 10


def parts(docs: DataFrame, size: int = 2000) -> tuple[DataFrame, int]:
    """All windows of the documents that may be learned from, dealt into ``(part, secret binary, rest binary)``, and the number of parts.

    A part gets some ``size`` windows of each kind; a kind with fewer windows than the parts hold goes to as many parts as that
    takes. What patterns found is secret, the rest are candidates that no pattern covers.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "text"):
            draws, nth, codes, truth = [], [], [], []
            for draw, text in zip(batch.column("draw").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans, first = base_findings(text), len(codes)
                rest = [piece for start, end in candidates(text) for piece in uncovered(text, start, end, spans)]
                for secret, pieces in ((True, values(text) if spans else []), (False, rest)):
                    for start, end in pieces:
                        for at in windows(start, end):
                            codes.append(encode(text, start, end, at))
                            truth.append(secret)
                draws += [draw] * (len(codes) - first)
                nth += range(len(codes) - first)
            yield pa.RecordBatch.from_pydict({"draw": pa.array(draws, pa.int64()), "nth": pa.array(nth, pa.int64()), "code": pa.array(codes, pa.binary()), "secret": pa.array(truth, pa.bool_())})

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("deal", "ascending"), ("code", "ascending")])
        code, secret = group.column("code").to_pylist(), group.column("secret").to_pylist()
        kinds = (b"".join(c for c, s in zip(code, secret, strict=True) if c is not None and s == kind) for kind in (True, False))
        return pa.table({"part": group.column("part")[:1], **dict(zip(("secret", "rest"), (pa.array([k], pa.binary()) for k in kinds), strict=True))})

    rows = docs.where(may_learn_from() & (F.octet_length("text") > 0)).select(F.xxhash64("doc_id").alias("draw"), "text")
    rows = stage(rows.mapInArrow(encoded, "draw long, nth long, code binary, secret boolean"), "windows")
    counts = {r["secret"]: r["n"] for r in rows.groupBy("secret").agg(F.count("*").alias("n")).collect()}
    n = max(1, -(-max(counts.values(), default=0) // size))
    copies = F.when(F.col("secret"), F.lit(min(n, max(1, n * size // max(1, counts.get(True, 0)))))).otherwise(F.lit(min(n, max(1, n * size // max(1, counts.get(False, 0))))))
    dealt = rows.select(F.xxhash64("draw", "nth", "secret").alias("deal"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), "code", "secret")
    dealt = dealt.select(F.pmod(F.pmod("deal", F.lit(n)) + F.col("copy"), F.lit(n)).cast("int").alias("part"), "deal", "code", "secret")
    every = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("part"), F.lit(0).cast("long").alias("deal"), F.lit(None).cast("binary").alias("code"), F.lit(False).alias("secret"))
    packed = dealt.unionByName(every).groupBy("part").applyInArrow(pack, "part int, secret binary, rest binary")
    return stage(packed.repartition(n), "parts"), n


@dataclass
class Part:
    """Rows of one part: made findings and the corpus's with mixed surroundings, their truth, unlabelled windows, which are held back, and the half of each unlabelled one."""

    codes: np.ndarray
    truth: np.ndarray
    held: np.ndarray
    rest: np.ndarray
    rest_held: np.ndarray
    half: np.ndarray

    @staticmethod
    def of(number: int, secret: bytes, rest: bytes, made: np.ndarray, made_truth: np.ndarray) -> Part:
        rows = [np.frombuffer(x, np.uint8).reshape(-1, BEFORE + INSIDE + AFTER) for x in (secret, rest)]
        draws = [np.array([zlib.crc32(c.tobytes()) for c in x], np.int64) for x in rows]  # equal windows are on one side in all parts
        codes, truth, unlabelled = mixed_surroundings(made, made_truth, *rows, seed=5 + number)
        return Part(codes, truth, np.concatenate([held_back(len(made)), draws[0] % 5 == 4]), unlabelled, draws[1] % 5 == 4, draws[1] // 5 % 2)

    def against(self, clean: np.ndarray, held: bool) -> tuple[np.ndarray, np.ndarray]:
        """Those held back or the others: labelled rows, and the clean ones of the unlabelled."""
        mine, others = self.held == held, clean & (self.rest_held == held)
        return np.concatenate([self.codes[mine], self.rest[others]]), np.concatenate([self.truth[mine], np.zeros(int(others.sum()), bool)])


def fit(docs: DataFrame, size: int = 2000, generated: int = 3000, seed: int = 7) -> Network:
    """Train on ``generated`` made findings and on all windows of the documents that may be learned from, in parts of some ``size`` of each kind.

    Each part has the made findings too. Two judges come first, each of one half of the unlabelled windows, and then two more that learn
    from what these took for clean; so does the final network, from what the second judges say of the half that each hasn't seen. What is held back is so by a window's hash.
    """
    made, made_truth = generated_findings(generated)
    made = np.frombuffer(b"".join(encode(*r) for r in made), np.uint8).reshape(len(made), BEFORE + INSIDE + AFTER)
    table, n = parts(docs, size)
    shared = docs.sparkSession.sparkContext.broadcast((made, made_truth))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Part]]:
        for batch in batches:
            for row in batch.to_pylist():
                yield row["part"], Part.of(row["part"], row["secret"], row["rest"], *shared.value)

    def trained(count: int, rounds: int, clean) -> list[Training]:
        """``count`` networks, after so many rounds; clean(part, k): the unlabelled windows that the k-th takes for clean."""
        now = [Training.start(np.random.default_rng(seed)) for _ in range(count)]
        for turn in range(rounds):

            def run(batches: Iterator[pa.RecordBatch], now: list[Training] = now, turn: int = turn) -> Iterator[pa.RecordBatch]:
                flat = [x.packed() for x in now]
                total = [np.zeros_like(x) for x in flat]
                for number, part in each(batches):
                    for k in range(count):
                        training = now[k].unpacked(flat[k] * _UNIT)
                        codes, truth = part.against(clean(part, k), False)
                        order = np.random.default_rng([seed, turn, number]).permutation(len(codes))
                        training.learn_from(codes[order], truth[order])
                        total[k] += training.packed()
                for k in range(count):
                    yield pa.RecordBatch.from_pydict({"k": np.full(len(total[k]), k, np.int32), "place": np.arange(len(total[k]), dtype=np.int32), "total": total[k]})

            sums = table.mapInArrow(run, "k int, place int, total long").groupBy("k", "place").agg(F.sum("total").alias("total")).toArrow().sort_by([("k", "ascending"), ("place", "ascending")])
            sums = sums.column("total").to_numpy().reshape(count, -1)
            now = [x.unpacked(flat / n * _UNIT) for x, flat in zip(now, sums, strict=True)]
        return now

    def settled(trainings: list[Training], recall: float, clean) -> list[Network]:
        nets = [x.network for x in trainings]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, part in each(batches):
                for k, net in enumerate(nets):
                    codes, truth = part.against(clean(part, k), True)
                    cells = np.floor(np.clip(net.logits(codes), -30, 30) / CELL).astype(np.int32)
                    yield pa.RecordBatch.from_pydict({"k": np.full(len(cells), k, np.int32), "cell": cells, "secret": pa.array(truth, pa.bool_())})

        counts = table.mapInArrow(run, "k int, cell int, secret boolean").groupBy("k", "cell", "secret").agg(F.count("*").alias("n")).toArrow().sort_by([("k", "ascending"), ("cell", "ascending"), ("secret", "ascending")])
        k, cell, secret, times = (counts.column(c).to_numpy() for c in ("k", "cell", "secret", "n"))
        return [settle(net, cell[k == i] * CELL, secret[k == i].astype(bool), times[k == i], recall) for i, net in enumerate(nets)]

    def clean(part: Part) -> np.ndarray:
        return np.ones(len(part.rest), bool)

    for _ in range(JUDGE_PASSES):
        other_half = lambda part, k, clean=clean: clean(part) & (part.half != k)
        judges = settled(trained(2, JUDGE_ROUNDS, other_half), JUDGE_RECALL, other_half)
        clean = lambda part, judges=judges: np.where(part.half == 0, *(judge.probability(part.rest) < judge.threshold for judge in judges))
    final = lambda part, k: clean(part)
    return settled(trained(1, ROUNDS, final), 0.99, final)[0]


def mixed_surroundings(made: np.ndarray, made_truth: np.ndarray, secret: np.ndarray, rest: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, their truth, and unlabelled codes: half of the findings, made ones and others, get the surroundings of other
    tokens of the corpus, so that these don't tell where a row is from."""
    rng = np.random.default_rng(seed)
    codes, around = np.concatenate([made, secret]), rest if len(rest) else made
    swapped = np.flatnonzero(rng.random(len(codes)) < 0.5)
    side = np.r_[0:BEFORE, BEFORE + INSIDE : BEFORE + INSIDE + AFTER]
    codes[np.ix_(swapped, side)] = around[rng.integers(len(around), size=len(swapped))][:, side]
    return codes, np.concatenate([made_truth, np.ones(len(secret), bool)]), rest


# -------------------------------------------------------------------- scanning


def find_all(texts: list[str | None], network: Network) -> list[list[Span]]:
    """Of each text pattern findings, and network findings in what they leave uncovered of a candidate, by start and then kind.

    A candidate is a finding if any of its windows is; so its probability is the greatest of theirs.
    """
    found: list[list[Span]] = []
    places, codes = [], []
    for row, text in enumerate(texts):
        spans = base_findings(text or "")
        found.append(spans)
        for start, end in candidates(text or ""):
            for first, last in uncovered(text, start, end, spans):
                for at in windows(first, last):
                    places.append((row, first, last))
                    codes.append(encode(text, first, last, at))
    if codes:
        p = network.probability(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1))
        for row, start, end in sorted({places[k] for k in np.flatnonzero(p >= network.threshold)}):
            found[row].append(("cnn", start, end))
    for spans in found:
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def scan(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """Every row of ``docs`` with ``secret_spans array<struct<kind, start, end>>``: pattern findings, and network findings in what no pattern covers.

    Null and empty texts have none; ids play no part, so null ids and repeated
    rows are scanned like others. A column named like the result is replaced.
    """
    network = fit(docs) if network is None else network
    keep = [c for c in docs.columns if c != "secret_spans"]
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand numbers

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch, _, _ in slices(batches, "text"):
            found = find_all(batch.column("text").to_pylist(), shared.value)
            spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], kind)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"secret_spans": spans})

    empty = F.array(F.struct(F.lit("").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")))
    schema = docs.select(*keep).withColumn("secret_spans", empty).schema
    return docs.select(*keep).mapInArrow(find, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts by kind, sha256 of the pattern findings and all findings as text."""
    spans = F.col("secret_spans")
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter(spans, lambda s: s["kind"] != "cnn"), text), ",")
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), count("cnn").alias("n_cnn"),
        F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(spans, text), ",").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", network: Network | None = None) -> DataFrame:
    """The same rows and columns with every finding in ``text`` replaced by ``mark``; overlapping findings become one mark."""
    network = fit(docs) if network is None else network
    keep = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            for row, spans in enumerate(find_all(texts, shared.value)):
                parts, at = [], 0
                for _, start, end in spans:
                    if start >= at:
                        parts += [texts[row][at:start], mark]
                    at = max(at, end)
                if spans:
                    texts[row] = "".join([*parts, texts[row][at:]])
            yield pa.RecordBatch.from_pydict({c: pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in keep})

    return docs.mapInArrow(cut, docs.schema)
