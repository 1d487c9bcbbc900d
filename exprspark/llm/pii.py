"""Personal data by candidate gradient boosting.

Generators propose overlapping candidate spans with high recall. Boosted trees score each one by its
format and its context; the scores are calibrated on candidates left out of the fit, and a candidate
beyond the base rules is redacted where its calibrated probability reaches its kind's threshold, the lowest
with precision `PRECISION` on those left out. The trees learn from every document: personal data
that the base rules find, and forms beyond them written into passages of the texts (addresses spoken out,
numbers without plus sign, shorter cards), against plain numbers, dates and versions. The checks of the
base rules are no features, so the trees cannot repeat them. Candidates are binned and counted once; each level of a
tree then sums gradients per node, feature and bin over the counts, task by task, and only those sums reach the driver.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.functions.ordering import running
from exprspark.llm import common
from exprspark.session import cut

KINDS = ("email", "ip", "card", "phone")
ROUNDS, DEPTH, RATE, BINS, RIDGE = 40, 3, 0.2, 24, 1.0
QUANTILES = [k / BINS for k in range(1, BINS)]
#: Trees after which the margins of the counted candidates are written anew.
KEPT = 10
PRECISION = 0.98
CONTEXT = 24

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = re.compile(r"\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,23}")
SPOKEN = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]+)+")
HINTS = re.compile(r"(?ai)(mail|contact)|(tel|phone|call|fax|mobile)|(card|visa|credit|account)|(\bip\b|host|server|address)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind, then start.

    Matches that a backtracking search would find in quadratic time on long runs are read off the runs: a chain of
    dotted numbers is cut into fours, an address grows left from its at sign.
    """
    out = [("email", *span) for span in emails(text)]
    for chain in DOTTED.finditer(text):
        parts = chain[0].split(".")
        at = chain.start()
        for k in range(0, len(parts) - len(parts) % 4, 4):
            own = parts[k : k + 4]
            size = sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in own):
                out.append(("ip", at, at + size))
            at += size + 1
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of all kinds: every base span, and looser forms."""
    found = dict.fromkeys(base_spans(text))
    found.update(dict.fromkeys(("email", *m.span()) for m in SPOKEN.finditer(text)) if "(at)" in text or "[at]" in text else {})
    for m in LOOSE.finditer(text):
        n = len(_digits(m[0]))
        found.update(dict.fromkeys((kind, *m.span()) for kind, low, high in (("phone", 7, 15), ("card", 13, 19)) if low <= n <= high))
    for m in DOTTED.finditer(text):
        if m[0].count(".") == 3 and len(m[0]) <= 19:
            found[("ip", *m.span())] = None
    return list(found)


FEATURES = 22


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of a span (length, digits, groups, separators) and its context (neighbours, hints, digits around)."""
    own, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = re.findall(r"[0-9]+", own)
    digits = "".join(groups)
    hints = [0.0] * 4
    for m in HINTS.finditer(before):
        hints[m.lastindex - 1] = 1.0
    parts = own.split(".")

    def neighbour(c: str) -> float:
        return 0.0 if not c or c.isspace() else 1.0 if c in ".,;:!?\"')" else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0

    return [
        *(float(kind == k) for k in KINDS), len(own), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        own.count(" "), own.count("-"), own.count("."), own.count("(") + own.count(")"), len(parts[-1]),
        neighbour(before[-1:]), neighbour(after[:1]), *hints, sum(c.isdigit() for c in before), sum(c.isdigit() for c in after)]


@dataclass
class Model:
    """Binned trees as flat arrays, the two numbers of the calibration and the threshold of each kind (above 1: none is added)."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = (2.0,) * len(KINDS)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)

    def leaves(self, bins: np.ndarray, r: int, depth: int = DEPTH) -> np.ndarray:
        """Node of each row among those of tree r at a depth."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            node = 2 * node + 1 + (bins[rows, self.feature[r][node]] > self.cut[r][node])
        return node - (2**depth - 1)

    def raised(self, bins: np.ndarray, rounds: range, margin: np.ndarray | float) -> np.ndarray:
        """The margin after further trees."""
        total = np.full(len(bins), 0.0) + margin
        for r in rounds:
            total += self.leaf[r][self.leaves(bins, r)]
        return total

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.raised(self.binned(x), range(len(self.leaf)), self.base)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -35, 35)))


def untrained(edges: list[np.ndarray], positive: float, count: float) -> Model:
    share = (positive + 1) / (count + 2)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    return Model(edges, np.zeros((ROUNDS, inner), np.int64), np.full((ROUNDS, inner), BINS + 1), np.zeros((ROUNDS, leaves)), float(np.log(share / (1 - share))))


def histograms(model: Model, r: int, level: int, bins: np.ndarray, y: np.ndarray, n: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Gradients and second derivatives of rows counted n times, summed by node of tree r's level, feature and bin."""
    p = 1 / (1 + np.exp(-margin))
    at = model.leaves(bins, r, level) * (BINS + 1)
    size = 2**level * (BINS + 1)
    return np.stack([[np.bincount(at + column, w, size).reshape(-1, BINS + 1) for column in bins.T] for w in (n * (p - y), n * p * (1 - p))])


def boost(model: Model, sums: Callable[[int, int], np.ndarray]) -> Model:
    """Second-order boosting of depth-3 trees for the logistic loss, from `sums(round, level)` of `histograms`."""
    for r in range(ROUNDS):
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            g, h = sums(r, level)  # features x nodes x bins
            best = np.full(nodes, 1e-9)
            for f in range(len(g)):
                gs, hs = g[f].cumsum(1), h[f].cumsum(1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (total_g - gs) ** 2 / (total_h - hs + RIDGE) - total_g**2 / (total_h + RIDGE)
                where = gain[:, :-1].argmax(1)
                value = gain[np.arange(nodes), where]
                for k in np.flatnonzero(value > best):
                    best[k], model.feature[r, first + k], model.cut[r, first + k] = value[k], f, where[k]
        for k in range(nodes):
            f, left = model.feature[r, first + k], model.cut[r, first + k] + 1
            for side, part in enumerate((slice(0, left), slice(left, None))):
                model.leaf[r, 2 * k + side] = -RATE * g[f, k, part].sum() / (h[f, k, part].sum() + RIDGE)
    return model


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees on arrays that are at hand."""
    edges = [np.unique(np.quantile(column, QUANTILES)) for column in x.T]
    model = untrained(edges, y.sum(), len(y))
    bins, ones = model.binned(x), np.ones(len(y))
    return boost(model, lambda r, level: histograms(model, r, level, bins, y, ones, model.raised(bins, range(r), model.base)))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Platt scaling on rows left out of the fit, by Newton steps with smoothed targets."""
    m = model.margin(x)
    positive, negative = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))

    def sums(a: float, b: float) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        w = p * (1 - p) + 1e-6
        return np.array([(w * m * m).sum(), (w * m).sum(), w.sum(), ((p - t) * m).sum(), (p - t).sum()])

    model.slope, model.shift = _newton(sums)
    return model


#: What stands before a number that is personal, and before one that is not.
PHONE_LEADS = ("tel ", "tel. ", "phone: ", "phone ", "call me at ", "call ", "mobile: ", "fax: ", "telephone: ", "call us at tel ")
CARD_LEADS = ("card ", "visa ", "credit card: ", "card number ", "my card is ", "visa card ")
MAIL_LEADS = ("mail ", "contact ", "e-mail: ", "write to ", "", "")
PLAIN_LEADS = ("order ", "id ", "total ", "page ", "year ", "number ", "about ", "isbn ", "", "", "")


def _grouped(r: random.Random, digits: str) -> str:
    """Digits in one of the usual groupings."""
    style = r.randrange(5)
    if style == 0:
        return digits
    if style == 1 and len(digits) >= 9:
        return f"({digits[:3]}) {digits[3:6]}-{digits[6:]}"
    sign, size = r.choice(" -."), r.choice((3, 4))
    return sign.join([digits[:size], digits[size:]] if style == 2 else [digits[i : i + size] for i in range(0, len(digits), size)])


def _number(r: random.Random, n: int) -> str:
    return str(r.randrange(10 ** (n - 1), 10**n))


def planted(r: random.Random) -> tuple[str, str, str | None]:
    """(lead, form, kind): a form beyond the base rules with what stands before it; kind is None for what is not personal."""
    what = r.randrange(6)
    if what == 0:
        return r.choice(PHONE_LEADS), _grouped(r, r.choice(("0", "")) + _number(r, r.randrange(9, 13))), "phone"
    if what == 1:
        head = _number(r, r.randrange(12, 15))
        digits = next(head + c for c in "0123456789" if luhn(head + c))
        return r.choice(CARD_LEADS), r.choice((digits, *(s.join([digits[:4], digits[4:8], digits[8:12], digits[12:]]) for s in " -"), f"{digits[:4]} {digits[4:10]} {digits[10:]}")), "card"
    if what == 2:
        name, host, top = ("".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randrange(2, 9))) for _ in range(3))
        at, dot = r.choice((" (at) ", "(at)", " [at] ", "[at]")), r.choice((" (dot) ", ".", "[dot]"))
        return r.choice(MAIL_LEADS), f"{name}{r.choice(('', str(r.randrange(99))))}{at}{host}{dot}{top[:3]}", "email"
    if what == 3:
        y, m, d = r.randrange(1900, 2100), r.randrange(1, 13), r.randrange(1, 29)
        sign = r.choice("-/.")
        date = r.choice((f"{y}{sign}{m:02}{sign}{d:02}", f"{d:02}{sign}{m:02}{sign}{y}", f"{y}-{y + r.randrange(9)}", f"{y} {y + 1}"))
        return r.choice((*PLAIN_LEADS, "call on ", "phone bill of ", "card of ", "mail of ")), date, None
    if what == 4:
        return r.choice(("version ", "host ", "section ", "")), ".".join(str(r.randrange(256, 999) if k == 2 else r.randrange(400)) for k in range(4)), None
    return r.choice(PLAIN_LEADS), _grouped(r, _number(r, r.randrange(7, 20))), None


#: Forms written into passages of each text.
PLANTS = 6


def examples(text: str) -> list[tuple[str, list[float], int, bool]]:
    """(kind, features, label, base) of a text's training candidates: what the base rules find is personal; other candidates are
    not, unless a hint of their own kind stands before them, which leaves them out; forms written in at `PLANTS` places."""
    base = set(base_spans(text))
    out = []
    for kind, start, end in candidates(text):
        x = describe(text, kind, start, end)
        hinted = x[-6 + {"email": 0, "phone": 1, "card": 2, "ip": 3}[kind]]
        if (kind, start, end) in base or not hinted:
            out.append((kind, x, int((kind, start, end) in base), (kind, start, end) in base))
    r = random.Random(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest())
    for _ in range(PLANTS):
        lead, form, planted_kind = planted(r)
        at = text.find(" ", r.randrange(len(text) + 1)) + 1
        before, after = text[max(0, at - 2 * CONTEXT) : at], text[at : at + 2 * CONTEXT]
        start = len(before) + len(lead)
        whole, end = f"{before}{lead}{form} {after}", start + len(form)
        known = set(base_spans(whole))
        for kind, a, b in candidates(whole):
            if a < end and start < b and (kind, a, b) not in known:
                out.append((kind, describe(whole, kind, a, b), int((kind, a, b) == (planted_kind, start, end)), False))
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch):
            keys, kinds, xs, ys, bases = [], [], [], [], []
            for text in part.column("text").to_pylist():
                for kind, x, y, base in examples(text or ""):
                    x = [float(v) for v in x]
                    keys.append(int.from_bytes(hashlib.blake2b(np.array([*x, len(text or "")]).tobytes(), digest_size=8).digest(), "little", signed=True))
                    kinds.append(KINDS.index(kind)), xs.append(x), ys.append(y), bases.append(base)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.int32()), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32()), pa.array(bases, pa.bool_())],
                                             names=["key", "kind", "x", "y", "base"])


def _newton(sums: Callable[[float, float], np.ndarray]) -> tuple[float, float]:
    """Slope and shift of Platt scaling from `sums(slope, shift)`: second derivatives (aa, ab, bb), then slopes (a, b)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        aa, ab, bb, ga, gb = sums(a, b)
        step = np.linalg.solve(np.array([[aa + 1e-3, ab], [ab, bb + 1e-3]]), np.array([ga + 1e-3 * (a - 1), gb]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


def _bins(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, FEATURES).astype(np.int64)


def _counted(found: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Candidates counted by their bins, kind, label, origin and side: (bins, kind, y, base, held, n)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, FEATURES)
            held = np.asarray(batch.column("key").to_numpy()) % 4 == 0
            bins = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in bins], pa.binary()), batch.column("kind"), batch.column("y"), batch.column("base"), pa.array(held)],
                                             names=["bins", "kind", "y", "base", "held"])

    rows = found.mapInArrow(work, "bins binary, kind int, y int, base boolean, held boolean")
    return rows.groupBy("bins", "kind", "y", "base", "held").agg(F.count(F.lit(1)).alias("n"))


def _with_margin(rows: DataFrame, model: Model, rounds: range) -> DataFrame:
    """Counted candidates with the margin after further trees."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = model.raised(_bins(batch.column("bins")), rounds, batch.column("margin").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(margin)], names=batch.schema.names)

    return rows.mapInArrow(work, rows.schema)


def _boosted(rows: DataFrame, model: Model) -> Model:
    """`boost` over counted candidates: one pass a level, whose sums are added up on the driver."""
    held = {"rows": rows, "from": 0}

    def sums(r: int, level: int) -> np.ndarray:
        if level == 0 and r > 0 and r % KEPT == 0:
            held["rows"], held["from"] = cut(_with_margin(held["rows"], model, range(held["from"], r))), r
        done = range(held["from"], r)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, FEATURES, 2**level, BINS + 1))
            for batch in batches:
                bins = _bins(batch.column("bins"))
                margin = model.raised(bins, done, batch.column("margin").to_numpy())
                total += histograms(model, r, level, bins, batch.column("y").to_numpy(), batch.column("n").to_numpy(), margin)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

        parts = held["rows"].mapInArrow(work, "sums array<double>").collect()  # one row of fixed length a task
        return np.sum([row[0] for row in parts], axis=0).reshape(2, FEATURES, 2**level, BINS + 1)

    return boost(model, sums)


def _chance(slope: float, shift: float):
    z = F.lit(slope) * F.col("margin") + F.lit(shift)
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))))


def _platt(rows: DataFrame) -> tuple[float, float]:
    """Platt scaling of counted candidates with smoothed targets."""
    positive, count = rows.agg(F.coalesce(F.sum(F.col("n") * F.col("y")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    target = F.when(F.col("y") > 0, F.lit((positive + 1) / (positive + 2))).otherwise(F.lit(1 / (count - positive + 2)))

    def sums(a: float, b: float) -> np.ndarray:
        p, m = _chance(a, b), F.col("margin")
        w, left = F.col("n") * (p * (1 - p) + 1e-6), F.col("n") * (p - target)
        row = rows.agg(*[F.coalesce(F.sum(e), F.lit(0.0)) for e in (w * m * m, w * m, w, left * m, left)]).first()
        return np.array(row, dtype=float)

    return _newton(sums)


def thresholds(rows: DataFrame) -> tuple[float, ...]:
    """Per kind the lowest probability p, at least a half, from which on `PRECISION` of the candidates (kind, p, y, n) are personal:
    midway to the next lower one; 2 where there is none."""
    scores = cut(rows.groupBy("kind", (-F.col("p")).alias("down")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("hit")))
    placed = running(scores, ["kind"], ["down"], ["n", "hit"])
    good = placed.where((F.col("hit_before") + F.col("hit") >= F.lit(PRECISION) * (F.col("n_before") + F.col("n"))) & (F.col("down") <= -0.5))
    last = good.groupBy("kind").agg(F.max("down").alias("last"))  # one row a kind
    below = scores.join(F.broadcast(last), "kind").groupBy("kind").agg(F.first("last").alias("last"), F.min(F.when(F.col("down") > F.col("last"), F.col("down"))).alias("next"))
    found = {r["kind"]: max(0.5, -(r["last"] + (r["next"] or 0.0)) / 2) for r in below.collect()}
    return tuple(found.get(k, 2.0) for k in range(len(KINDS)))


def train(docs: DataFrame) -> Model | None:
    """A calibrated model from the candidates of every document; those whose hash is divisible by four are left out of the fit. None
    where there are fewer than 20 candidates of either class: then only the base rules speak."""
    found = cut(docs.select("text").mapInArrow(_examples, "key bigint, kind int, x array<double>, y int, base boolean"))
    fitted = found.where(F.pmod("key", F.lit(4)) != 0)
    count, positive, few = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0)), F.count_if(F.pmod("key", F.lit(4)) != 0)).first()
    if min(positive, count - positive) < 20 or few == 0:
        return None
    # the features are small whole numbers: an exact quantile holds the counts of the distinct ones
    edges = fitted.agg(*[F.percentile(F.col("x")[f], F.array(*map(F.lit, QUANTILES))).alias(f"_{f}") for f in range(FEATURES)]).first()
    own, size = fitted.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    model = untrained([np.unique(np.array(e, dtype=float)) for e in edges], own, size)
    counted = cut(_counted(found, model.edges).withColumn("margin", F.lit(model.base)))
    model = _boosted(counted.where("not held"), model)
    scored = cut(_with_margin(counted.where("held"), model, range(ROUNDS)))
    model.slope, model.shift = _platt(scored)
    loose = scored.where("not base")  # base spans stay anyway
    model.thresholds = thresholds(loose.select("kind", _chance(model.slope, model.shift).alias("p"), "y", "n"))
    return model


def select(text: str, model: Model | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans): a candidate outside the base is added if its probability suffices and it overlaps none chosen before."""
    base = base_spans(text)
    order = {kind: k for k, kind in enumerate(KINDS)}
    base.sort(key=lambda s: (order[s[0]], s[1]))
    more = [] if model is None else [c for c in candidates(text) if not any(c[1] < end and start < c[2] for _, start, end in base)]
    if not more:
        return base, base
    p = model.probability(np.array([describe(text, *c) for c in more], dtype=float))
    chosen = list(base)
    for i in np.argsort(-p, kind="stable"):
        if p[i] >= model.thresholds[KINDS.index(more[i][0])] and not any(more[i][1] < end and start < more[i][2] for _, start, end in chosen):
            chosen.append(more[i])
    return base, sorted(chosen, key=lambda s: (order[s[0]], s[1]))


def redactions(docs: DataFrame, model: Model | None = None, fitted: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs.

    Spans are kind:start:end in code points, end exclusive, by kind, then start. Null and empty texts have none. The
    model is trained on docs unless `fitted`. Rows are judged one by one, so repeated rows agree and ids do not matter.
    """
    model = model if fitted else train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, spans = select(text or "", shared.value)
                joined = [",".join(f"{kind}:{start}:{end}" for kind, start, end in s) for s in (base, spans)]
                out.append((doc_id, *(sum(s[0] == kind for s in base) for kind in KINDS), hashlib.sha256(joined[0].encode()).hexdigest(), joined[1]))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])],
                                             names=["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(judge, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
