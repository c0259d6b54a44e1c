"""Text statistics and types: thresholds as noisy labelling functions, weighed by expectation-maximisation.

Each line gets votes from thresholds on its statistics (share of common words, symbols, digits, word
length, word count, closing punctuation, lower-case words, field separators). A vote says "running
sentence", "something else" or nothing. How far each threshold can be trusted is learned from how the
votes agree over all lines, without labels (Dawid and Skene's model), and gives the probability that
a line with a given pattern of votes is running text. Types of documents come from a second model of the same kind:
thresholds on a document's statistics, the share of its characters outside running lines among them, vote
for prose, list, table or junk, often for several of them at once; how often each class gets each vote is
learned over all documents, and every document has the probabilities of the four types.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.arrow import texts_of
from gristmill.functions.codepoints import Batch, batches, word_hashes
from gristmill.session import checkpoint

# Frequent function words of the four languages.
COMMON_WORDS = (
    "a after an and are as at be before but by can do each for from has have if in into is it its may must not of on only or should that the their they this through to was were when which while who why will with you "
    "après au aux avant avec ce cette dans de des depuis du elle en est et il la le les mais ne ou par pas pour puis que qui sa se si son sont sur un une vous "
    "ab als am auf aus bei bis das dem den der die durch ein eine einen er für im ist kein mit nach nicht noch nur oder sie sind und vom von vor war warum weil wenn werden wurde zu zum zur "
    "al antes como con cada cuando del después desde donde el ella entre es esta este fue los las lo más no para pero por qué según ser sin sobre solo su sus también tras unos y"
).split()

CLOSING = ".!?…:;。"
QUOTES = "\"'”’»)*_"
SEPARATORS = "|;\t={}<>[]\\"

#: name, statistic, low, high, trust: a line votes "running" from high up and "else" up to low; reversed where
#: low > high. Trust is where learning starts from, and weighs as much as PRIOR lines.
LABELLERS = (
    ("common", "common_share", 0.07, 0.16, 3.0),
    ("symbols", "symbol_ratio", 0.14, 0.06, 1.0),
    ("digits", "digit_ratio", 0.25, 0.12, 1.0),
    ("length", "mean_length_off", 3.5, 1.8, 1.0),
    ("words", "words", 3, 6, 2.0),
    ("closing", "closed", -1, 1, 2.0),
    ("lower", "plain_share", 0.35, 0.62, 1.0),
    ("fields", "separators", 2, -1, 2.0),
)
PRIOR = 20.0


def line_statistics(batch: Batch, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Document, characters and statistics of each line that isn't blank, or of short lines that go on into one another."""
    cp = batch.cp
    breaks = (cp == 10) | (cp == 0)
    end = np.flatnonzero(breaks)
    start = np.concatenate([[0], end[:-1] + 1])

    def per_line(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return total[end] - total[start]

    space, word, digit = batch.has("space"), batch.has("word"), batch.has("digit")
    solid = per_line(~space & ~breaks)
    live = np.flatnonzero(solid > 0)
    w_start, w_end, hashes, _ = batch.words()
    line, lines = np.searchsorted(end, w_start), len(end)
    has_digit = np.concatenate([[0], np.cumsum(digit)])
    plain = (has_digit[w_end] == has_digit[w_start]) & (w_end - w_start <= 15)
    skip = ~space & ~breaks & ~np.isin(cp, [ord(c) for c in QUOTES])  # the last character that closes a sentence or not
    last = np.maximum.accumulate(np.where(skip, np.arange(len(cp)), -1))[end]
    lead = ~space & ~breaks & ~np.isin(cp, [ord(c) for c in ">/*"])
    head = np.minimum(np.minimum.accumulate(np.where(lead, np.arange(len(cp)), len(cp) - 1)[::-1])[::-1][start], end)
    sums = {
        "words": np.bincount(line, minlength=lines), "length": np.bincount(line, weights=w_end - w_start, minlength=lines),
        "common": np.bincount(line, weights=np.isin(hashes, common), minlength=lines), "plain": np.bincount(line, weights=plain, minlength=lines),
        "solid": solid, "digits": per_line(digit), "symbols_all": per_line(~space & ~word & ~breaks),
        "symbols": per_line(~space & ~word & ~breaks & ~np.isin(cp, [ord(c) for c in ".,'’:?!-¿¡*>/()\""])),
        "separators": per_line(np.isin(cp, [ord(c) for c in SEPARATORS])),
        "closing": np.isin(cp[np.maximum(last, 0)], [ord(c) for c in CLOSING]) & (last >= start), "chars": end - start, "lines": np.ones(lines, dtype=np.int64),
    }
    sums = {k: v[live].astype(float) for k, v in sums.items()}
    owner = batch.doc_of(start[live])
    # Short lines that go on into the next are read together, as narrow columns cut sentences up.
    open_end = (sums["words"] < 10) & (sums["closing"] == 0)
    goes_on = (np.diff(live) == 1) & (np.diff(owner) == 0) & open_end[:-1] & word[head[live[1:]]]
    unit = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(live) else live
    final = np.concatenate([unit[1:], [len(live)]])[: len(unit)] - 1
    out = {k: np.add.reduceat(v, unit) if len(unit) else v for k, v in sums.items()}
    words, solid = np.maximum(out["words"], 1), np.maximum(out["solid"], 1)
    out |= {
        "common_share": out["common"] / words, "symbol_ratio": out["symbols"] / solid, "digit_ratio": out["digits"] / solid, "mean_length_off": np.abs(out["length"] / words - 5.2),
        "plain_share": out["plain"] / words, "closed": sums["closing"][final] if len(unit) else sums["closing"],
    }
    return owner[unit], out["chars"], out


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """One number per line whose base-3 digits are the votes: 0 none, 1 running, 2 else."""
    code = np.zeros(len(stats["words"]), dtype=np.int64)
    for _, name, low, high, _ in LABELLERS:
        x = stats[name]
        run, other = (x >= high, x <= low) if low < high else (x <= high, x >= low)
        code = code * 3 + np.where(other, 2, np.where(run, 1, 0))
    return code


def digits_of(codes: np.ndarray) -> np.ndarray:
    m = len(LABELLERS)
    return (codes[:, None] // 3 ** np.arange(m - 1, -1, -1)) % 3


def learn(seen: np.ndarray, weight: np.ndarray, likely: np.ndarray, prior: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Class probabilities of each pattern of votes, and P(vote | class) of each labeller, by expectation-maximisation.

    seen has a row of votes for each pattern and weight says how often it occurs. Learning starts from
    likely[class, labeller, vote] and prior, which weigh as much as PRIOR imagined cases throughout, so that classes
    don't drift where there are few cases or all are of one kind.
    """
    k, m, size = likely.shape
    table, share = likely, prior / prior.sum()
    p = np.full((len(seen), k), 1 / k)
    for _ in range(rounds):
        score = np.log(share) + sum(np.log(table[:, j, :])[:, seen[:, j]].T for j in range(m))
        score -= score.max(axis=1, keepdims=True) if len(seen) else 0
        new = np.exp(score)
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
        mass = p * weight[:, None]
        counts = np.stack([np.stack([np.bincount(seen[:, j], weights=mass[:, c], minlength=size) for j in range(m)]) for c in range(k)])
        table = counts + PRIOR * likely
        table /= table.sum(axis=2, keepdims=True)
        share = mass.sum(axis=0) + PRIOR * prior
        share /= share.sum()
    return p, table


def posteriors(codes: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Probability that a line with each pattern is running text, and P(vote | class) of each labeller."""
    right = 1 / (1 + np.exp(-np.array([x[4] for x in LABELLERS])))
    likely = np.stack([np.stack([np.full(len(right), 0.2), 0.8 * a, 0.8 * b], axis=1) for a, b in ((right, 1 - right), (1 - right, right))])
    p, table = learn(digits_of(codes), weight, likely, np.ones(2), rounds)
    return p[:, 0], table


TYPES = ("prose", "list", "table", "junk")
#: name, statistic, low, high, types voted for up to low, types voted for from high on: as LABELLERS, but a vote may be for several types.
DOCUMENT_LABELLERS = (
    ("outside", "outside_share", 0.5, 0.500001, ("prose",), ("list", "table", "junk")),
    ("symbols", "symbol_ratio", 0.09, 0.14, ("prose", "list"), ("table",)),
    ("length", "mean_word_length", 9.0, 13.0, ("prose", "list", "table"), ("junk",)),
    ("line", "words_per_line", 0.999999, 10.0, ("junk",), ("prose",)),
    ("fields", "separators_per_line", 0.5, 1.5, ("prose", "list", "junk"), ("table",)),
    ("digits", "digit_ratio", 0.06, 0.25, ("prose", "list"), ("table", "junk")),
    ("closing", "closed_line_share", 0.15, 0.6, ("list", "table", "junk"), ("prose",)),
    ("common", "common_word_share", 0.03, 0.15, ("table", "junk"), ("prose",)),
)
RIGHT, SILENT = 0.9, 0.2  # how often votes are thought to be right, and missing, before anything is learned


def document_votes() -> Column:
    """One number per document whose base-3 digits are the votes: 0 none, 1 low, 2 high."""
    code = F.lit(0)
    for _, name, low, high, _, _ in DOCUMENT_LABELLERS:
        code = code * 3 + F.when(F.col(name) >= high, 2).when(F.col(name) <= low, 1).otherwise(0)
    return code


def type_posteriors(codes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of TYPES of each pattern of document votes, and P(vote | type) of each labeller."""
    likely = np.empty((len(TYPES), len(DOCUMENT_LABELLERS), 3))
    for c, name in enumerate(TYPES):
        for j, (*_, low, high) in enumerate(DOCUMENT_LABELLERS):
            for v, own, other in ((1, low, high), (2, high, low)):
                # A type that neither vote names gets both alike.
                likely[c, j, v] = (1 - SILENT) * (RIGHT if name in own else 1 - RIGHT if name in other else 0.5)
            likely[c, j, 0] = SILENT
    return learn(digits_of(codes), weight, likely / likely.sum(axis=2, keepdims=True), np.array([4.0, 1.0, 1.0, 1.0]) / 7)


def profile(docs: DataFrame) -> DataFrame:
    """Statistics of each document, and how many of its characters and lines have each pattern of votes."""
    common = np.sort(np.concatenate([word_hashes(w) for w in dict.fromkeys(COMMON_WORDS)]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, last, batch in batches(texts_of(part.column("text"))):
                owner, chars, stats = line_statistics(batch, common)
                code = votes(stats)
                sums = {k: np.bincount(owner, weights=v, minlength=batch.n) for k, v in ((k, stats[k]) for k in ("chars", "lines", "words", "length", "symbols_all", "solid", "closing", "common", "digits", "separators"))}
                key, at = np.unique(owner * 3 ** len(LABELLERS) + code, return_inverse=True)
                row, pattern = np.divmod(key, 3 ** len(LABELLERS))
                offsets = pa.array(np.searchsorted(row, np.arange(batch.n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pattern.astype(np.int32), np.bincount(at, weights=chars, minlength=len(key)).astype(np.int64), np.bincount(at, minlength=len(key)).astype(np.int64))]
                safe = lambda a, b: np.divide(a, b, out=np.zeros(batch.n), where=b > 0)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").slice(first, last - first), pa.array(sums["chars"].astype(np.int64)), pa.array(sums["lines"].astype(np.int64)), pa.array(sums["words"].astype(np.int64)),
                    pa.array(safe(sums["length"], sums["words"])), pa.array(safe(sums["symbols_all"], sums["solid"])), pa.array(safe(sums["closing"], sums["lines"])), pa.array(safe(sums["common"], sums["words"])), pa.array(safe(sums["digits"], sums["solid"])), pa.array(safe(sums["separators"], sums["lines"])), *lists,
                ], ["id", "chars", "lines", "words", "mean_word_length", "symbol_ratio", "closed_line_share", "common_word_share", "digit_ratio", "separators_per_line", "patterns", "pattern_chars", "pattern_lines"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, chars bigint, lines bigint, words bigint, mean_word_length double, symbol_ratio double, closed_line_share double, common_word_share double, digit_ratio double, separators_per_line double, patterns array<int>, pattern_chars array<bigint>, pattern_lines array<bigint>")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", types: bool = True) -> DataFrame:
    """One row per input row: statistics, the share of characters outside running text and, if wanted, the type and probabilities of all types.

    The type is the likeliest of prose, list, table and junk, ties in that order; a null or blank text is empty, without
    probabilities. Repeated rows each give a row; other columns aren't read; an empty table gives an empty one.
    """
    base = checkpoint(profile(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))))
    counted = base.select(F.explode(F.arrays_zip("patterns", "pattern_lines")).alias("x")).groupBy("x.patterns").agg(F.sum("x.pattern_lines").alias("lines")).orderBy("patterns").collect()  # at most 3**8 rows
    codes = np.array([r["patterns"] for r in counted], dtype=np.int64)
    p, _ = posteriors(codes, np.array([r["lines"] for r in counted], dtype=float))
    outside = codes[p < 0.5].tolist()
    rows = base.select(F.col("id").alias(id_col), "chars", "lines", "words", "mean_word_length", "symbol_ratio", "closed_line_share", "common_word_share", "digit_ratio", "separators_per_line", _share(outside).alias("outside_share"))
    if not types:
        return rows
    rows = rows.withColumn("words_per_line", F.try_divide("words", "lines")).withColumn("pattern", F.when(F.col("lines") > 0, document_votes()))
    seen = rows.where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # at most 3**8 rows
    codes = np.array([r["pattern"] for r in seen], dtype=np.int64)
    p, _ = type_posteriors(codes, np.array([r["n"] for r in seen], dtype=float))
    known = [(int(c), TYPES[int(x.argmax())], *map(float, x)) for c, x in zip(codes, p)]
    table = docs.sparkSession.createDataFrame(known, "pattern int, text_type string, " + ", ".join(f"p_{t} double" for t in TYPES))
    return rows.join(F.broadcast(table), "pattern", "left").drop("pattern", "words_per_line").withColumn("text_type", F.coalesce("text_type", F.lit("empty")))


def _share(outside: list[int]) -> Column:
    hit = F.filter(F.arrays_zip("patterns", "pattern_chars"), lambda x: F.array_contains(F.lit(outside) if outside else F.array().cast("array<int>"), x["patterns"]))
    return F.when(F.col("chars") > 0, F.aggregate(hit, F.lit(0).cast("bigint"), lambda a, x: a + x["pattern_chars"]) / F.col("chars"))
