"""Quality rules: decision lists learned by sequential covering over text statistics.

``statistics`` computes the statistics of every whole text in one pass without a shuffle. ``learn`` grows conjunctions
of thresholds for the class "bad" from labelled statistics (FOIL gain on one part of the labelled rows), prunes them on
the other part, and removes what each rule covers before the next one. ``DecisionList.expression`` is the ordered Spark
conditional expression (CASE WHEN ... END) that the optimizer compiles like any other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Most labelled rows of each label value that a fit takes.
FIT_ROWS = 6_000

#: White space between words, and the characters that count as symbols.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_letters", "n_marks", "n_unique_words", "n_stops"]
STATS_DDL = ", ".join(f"{c} bigint" for c in BASE + MORE)

#: Interpretable ratios that rules may test, as SQL over the statistics.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "unique_share": "n_unique_words / greatest(n_words, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_NOT_LETTER = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))
_CONT = bytes(range(0x80, 0xC0))
_MARKS = b"!?;:,()\"'"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of ``width`` words that the text has twice or more, first ones included."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    put = known.setdefault
    ids = np.array([put(w, len(known)) for w in words], np.uint64)
    if len(known) > n - 1:
        return 0
    mult = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
    m = n - width + 1
    h = np.zeros(m, np.uint64)
    for k in range(width):
        x = ids[k : k + m] * mult[k % 5] + np.uint64(k + 1)
        h = (h ^ (x ^ (x >> np.uint64(29)))) * mult[(k + 1) % 5]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    # exact: windows of equal hash are compared by their words
    rows = np.stack([ids[at + k] for k in range(width)], axis=1)
    _, back, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[times[back.ravel()] > 1]
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + width, -1)
    return int((np.cumsum(inside)[:n] > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The statistics of one text (null: as empty), in the order of BASE + MORE."""
    if not text:
        return (0,) * len(BASE + MORE)
    words = text.split()
    solid = text.translate(None, SPACE)
    chars = len(solid.translate(None, _CONT))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = text.split(b"\n")
    dup = n_lines = stops = 0
    seen = set()
    for line in lines:
        bare = line.strip(SPACE)
        if bare:
            n_lines += 1
            stops += bare[-1] in b".!?"
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    upper = len(solid) - len(solid.translate(None, _UPPER))
    digits = len(solid) - len(solid.translate(None, _DIGIT))
    letters = len(solid.translate(None, _NOT_LETTER + _CONT))
    marks = len(solid) - len(solid.translate(None, _MARKS))
    return (len(words), chars, symbols, dup, repeated_words(words), n_lines, upper, digits, letters, marks, len(set(words)), solid.count(b"."))


def stats_kernel(texts: list) -> dict:
    got = np.array([measure(t) for t in texts], np.int64)
    return {c: got[:, i] for i, c in enumerate(BASE + MORE)}


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with one bigint column for each statistic; a null or empty text has zeros.

    Columns of ``docs`` with the name of a statistic are replaced by it. Texts of any length are read whole.
    """
    common.bound_batches(docs.sparkSession)
    made = common.text_kernel(stats_kernel, STATS_DDL)(F.col(text))
    return common.with_struct(docs, made, BASE + MORE, keep)


def base_failed(min_words: int = 10, repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    limit: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.limit!r}D"

    def of(self, x: dict) -> np.ndarray:
        return x[self.feature] > self.limit if self.above else x[self.feature] <= self.limit


@dataclass
class DecisionList:
    """Ordered rules; the first conjunction that holds marks the text as bad, else it is good."""

    rules: list[list[Test]] = field(default_factory=list)

    def expression(self) -> Column:
        """True (keep) or false, as an ordered conditional expression over the statistics."""
        out = None
        for rule in self.rules:
            cond = F.expr(" AND ".join(t.sql() for t in rule))
            out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def rule_number(self) -> Column:
        """1 for the first rule that holds, and so on; 0 if none does."""
        out = None
        for i, rule in enumerate(self.rules):
            cond = F.expr(" AND ".join(t.sql() for t in rule))
            out = F.when(cond, F.lit(i + 1)) if out is None else out.when(cond, F.lit(i + 1))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def bad(self, x: dict) -> np.ndarray:
        n = len(next(iter(x.values()))) if x else 0
        out = np.zeros(n, bool)
        for rule in self.rules:
            out |= covered(rule, x, n)
        return out


def covered(rule: list[Test], x: dict, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= t.of(x)
    return out


def thresholds(v: np.ndarray, most: int = 48) -> np.ndarray:
    """Midpoints between values at quantiles."""
    u = np.unique(v)
    if len(u) < 2:
        return np.zeros(0)
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= most else np.unique(np.quantile(mid, np.linspace(0, 1, most), method="nearest"))


def grow(x: dict, bad: np.ndarray, most_tests: int) -> list[Test]:
    """A conjunction that covers bad rows, by the highest FOIL gain at each step."""
    rule: list[Test] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most_tests:
        p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
        if not n0 or not p0:
            break
        before = np.log2(p0 / (p0 + n0))
        best, gain = None, 1e-9
        for name, v in x.items():
            vi, bi = v[inside], bad[inside]
            order = np.argsort(vi, kind="stable")
            sv = vi[order]
            cp = np.concatenate([[0], np.cumsum(bi[order])])
            for t in thresholds(sv):
                k = int(np.searchsorted(sv, t, side="right"))
                for above, p, n in ((False, cp[k], k - cp[k]), (True, p0 - cp[k], (len(sv) - k) - (p0 - cp[k]))):
                    if p and (g := p * (np.log2(p / (p + n)) - before)) > gain:
                        best, gain = Test(name, above, float(t)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.of(x)
    return rule


def worth(rule: list[Test], x: dict, bad: np.ndarray) -> float:
    c = covered(rule, x, len(bad))
    p, n = int((bad & c).sum()), int((~bad & c).sum())
    return (p - n) / (p + n) if p + n else -1.0


def prune(rule: list[Test], x: dict, bad: np.ndarray) -> list[Test]:
    """Drops final tests as long as the worth on rows that growing has not seen does not fall."""
    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k], x, bad) >= worth(best, x, bad):
            best = rule[:k]
    return best


def learn(x: dict, bad: np.ndarray, most_rules: int = 12, most_tests: int = 4, precision: float = 0.95, least: int = 5, seed: int = 7) -> DecisionList:
    """Sequential covering. A rule must be right on ``precision`` of the rows it covers and cover ``least`` bad rows."""
    n = len(bad)
    found = DecisionList()
    left = np.ones(n, bool)
    rng = np.random.default_rng(seed)
    for _ in range(most_rules):
        at = np.flatnonzero(left)
        if bad[at].sum() < least:
            break
        part = rng.random(len(at)) < 2 / 3
        g, p = at[part], at[~part]
        rule = grow({k: v[g] for k, v in x.items()}, bad[g], most_tests)
        if not rule:
            break
        rule = prune(rule, {k: v[p] for k, v in x.items()}, bad[p]) if bad[p].any() else rule
        c = covered(rule, x, n) & left
        hits = int((bad & c).sum())
        if hits < least or hits < precision * int(c.sum()):
            break
        found.rules.append(rule)
        left &= ~c
    return found


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS, precision: float = 0.95) -> DecisionList:
    """A list learned from at most ``bound`` labelled texts of each quality; without labels there are no rules."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    picked = common.labelled_sample(labels, "quality", bound, "doc_id")
    worst: dict = {}
    for k, y in picked:
        worst[k] = min(y, worst.get(k, y))  # of two labels of a document the worse counts
    if len(set(worst.values())) < 2:
        return DecisionList()
    wanted = F.broadcast(common.local_table(spark, [(k, int(y)) for k, y in worst.items()], "doc_id bigint, __quality int"))
    rows = statistics(docs.select("doc_id", "text").join(wanted, "doc_id"), keep=["doc_id", "__quality"])
    got = rows.select("__quality", F.xxhash64("doc_id").alias("h"), *[F.expr(e).alias(c) for c, e in FEATURES.items()]).toPandas()
    got = got.sort_values(["h", *FEATURES], kind="stable")
    return learn({c: got[c].to_numpy(float) for c in FEATURES}, got["__quality"].to_numpy() == 0, precision=precision)


def judged(docs: DataFrame, rules: DecisionList, keep: list[str] | None = None) -> DataFrame:
    """Statistics with base_failed, rule (its number, 0 for none) and kept.

    A null or empty text fails the base rule and is not kept. Rows are neither joined nor merged: repeated rows and
    null ids each get their verdict, equal texts the same one. The first rule that holds counts. A text of any length is
    measured whole; columns named like a new one, in whatever case, are replaced; an empty table gives an empty result.
    """
    out = statistics(docs, keep=keep).withColumn("base_failed", base_failed())
    return out.withColumn("rule", rules.rule_number()).withColumn("kept", ~F.col("base_failed") & rules.expression())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their own columns, that the base rule and a list learned from ``labels`` keep.

    Null and empty texts go; repeated rows and null ids are judged like others. Without labels the base rule alone holds.
    """
    rules = fit(docs, labels)
    made = common.text_kernel(stats_kernel, STATS_DDL)(F.col("text"))
    names = docs.columns
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), made.alias("__stats")).select("__row", "__stats.*")
    return tagged.where(~base_failed() & rules.expression()).select(*[F.col("__row").getField(c).alias(c) for c in names])
