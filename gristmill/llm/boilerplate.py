"""Main body of web pages: template deduction from equivalence classes of tokens on same-host pages.

A token is a word in its context: the word before it in its segment (menu item, notice, sentence) and
whether its line is a long one; numbers and names of models are masked, and a segment of a long line is one
token. Tokens of one host with the same occurrence vector over its pages form an equivalence
class. The vector is kept as a linear fingerprint, a sum of page hashes, so that classes of any host are
found by grouping and no list of pages is ever gathered.

A class is valid if it is frequent and ordered, that is if its tokens come in one order on all
pages that have them; the tokens of any other are classes of their own. Valid classes nest: the parent of a
class is the one whose tokens stand around it on most of its pages. Whether a class is furniture or
running text is decided by the log odds of its words in short against long lines, pooled over the
class and its parent. Furniture classes are the host's template. Lines that the template fills are
furniture; what remains are slots. A slot between running text is main body, whatever its words; a
slot that the template bounds is furniture too if its own words say so (a notice or teaser of one page).
Where a host has no template, nothing is furniture.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.arrow import texts_of
from gristmill.functions.codepoints import BASE, MASK, Batch, batches, mix, powers
from gristmill.session import checkpoint

LONG_LINE = 13  # words from which on a line counts as running text, unless pages of its host repeat it
NUMBER, MODEL, OPENING = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC6A4A7935BD1E995), np.uint64(0x8CB92BA72F3D8DD7)
#: A feature must be seen so often to have a weight.
LEAST = 4
PRIOR, PAIR_GAIN = 3.0, 1.0
LEAST_PAGES = 3
LIMIT = 3.0
#: A line is furniture from this score on; one that is shaped like a sentence needs more. A slot that the template bounds needs less, by SLOT.
THRESHOLD, SENTENCE_THRESHOLD, SENTENCE_WORDS, OPEN_SENTENCE_WORDS, SLOT = 0.6, 1.15, 6, 9, 0.2
COVER = 0.2  # share of a line's words that template tokens must fill
NEST, NEST_LIMIT, BOUND, SLOT_ROUNDS = 0.1, 2.0, 0.3, 3
#: Characters of the pages whose weights are looked up together, and of a batch.
CHUNK_CHARS, BATCH_CHARS = 1 << 20, 1 << 22
WORDS, PAIRS = 0, 1
#: What is kept of a page: an entry for each token, a row for each line.
ENTRY = np.dtype([("token", "<u8"), ("line", "<i4"), ("odds", "<f4"), ("known", "<u2"), ("size", "<u2")])
LINE = np.dtype([("unit", "<i4"), ("solid", "?"), ("sentence", "?")])


class Page:
    """Lines, segments and masked words of a batch of texts."""

    def __init__(self, batch: Batch):
        cp = batch.cp
        self.owner_of = batch.doc_of
        self.line_end = np.flatnonzero((cp == 10) | (cp == 0))
        self.line_start = np.concatenate([[0], self.line_end[:-1] + 1])
        start, end, hashes, _ = batch.words()
        digits = np.concatenate([[0], np.cumsum(batch.has("digit"))])
        number = digits[end] - digits[start] == end - start
        letter = np.concatenate([[0], np.cumsum(batch.has("letter"))])
        model = np.zeros(len(start), dtype=bool)
        if len(start) > 1:
            dash = np.isin(cp[np.minimum(end[:-1], len(cp) - 1)], (0x2D, 0x2011)) & (start[1:] == end[:-1] + 1)
            model[:-1] = dash & number[1:] & (end[:-1] - start[:-1] == 2) & (letter[end[:-1]] - letter[start[:-1]] == 2)
            keep = np.concatenate([[True], ~model[:-1]])
        else:
            keep = np.ones(len(start), dtype=bool)
        tail = np.concatenate([end[1:], end[-1:]]) if len(end) else end
        end = np.where(model, tail, end)
        self.word = np.where(model, MODEL, np.where(number, NUMBER, hashes))[keep]
        self.masked = (model | number)[keep]
        self.model = model[keep]
        start, end = start[keep], end[keep]
        self.line = np.searchsorted(self.line_end, start)
        self.line_owner = batch.doc_of(self.line_start)
        filled = np.concatenate([[0], np.cumsum(~batch.has("space") & (cp != 0))])
        self.solid = filled[self.line_end] > filled[self.line_start]
        self.unit = self.units(batch, np.bincount(self.line, minlength=len(self.line_end)))
        self.line_words = np.bincount(self.unit[self.line], minlength=len(self.line_end))[self.unit]
        space = batch.has("space")
        nxt, before = np.concatenate([space[1:], [False]]), np.concatenate([[False], space[:-1]])
        cut = np.isin(cp, [ord(c) for c in "|›>»·/"]) | (space & nxt) | (np.isin(cp, [ord(c) for c in ".!?:,"]) & nxt) | (np.isin(cp, [ord(c) for c in "-–—"]) & nxt & before)
        cuts = np.concatenate([[0], np.cumsum(cut)])
        row = np.isin(cp[self.line_start], [ord("|")])  # a row of a table is one segment
        new = np.ones(len(start), dtype=bool)
        if len(start):
            new[1:] = (self.line[1:] != self.line[:-1]) | ((cuts[start[1:]] > cuts[end[:-1]]) & ~row[self.line[1:]])
        self.segment = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.concatenate([self.first, [len(start)]]))
        has_model = np.bincount(self.line, weights=self.model, minlength=len(self.line_end)) > 0
        seg_line = self.line[self.first]
        self.short = self.line_words < LONG_LINE
        power, inverse = powers(len(start) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.word * power[: len(start)], dtype=np.uint64)])
            last = self.first + self.size
            whole = mix((total[last] - total[self.first]) * inverse[self.first] + has_model[seg_line].astype(np.uint64) + np.uint64(2))
            before = np.concatenate([[OPENING], self.word[:-1]]) if len(start) else self.word
            before = np.where(new, OPENING, before).astype(np.uint64)
            in_context = mix(self.word * np.uint64(BASE & MASK) + before)
            # One token for each word of short lines and for each segment of long ones, in order.
            lead = np.flatnonzero(self.short[self.line] | new)
            alone = ~self.short[self.line[lead]]
            self.token = np.where(alone, whole[self.segment[lead]], in_context[lead])
            self.token_line, self.token_at = self.line[lead], lead
            # Long lines, wrapped ones joined: number of the unit, hash of its words.
            unit = self.unit[self.line]
            head = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) if len(unit) else np.empty(0, np.int64)
            tail = np.concatenate([head[1:], [len(unit)]]) if len(unit) else head
            head, tail = (x[~self.short[unit[head]]] for x in (head, tail))
            self.long_unit = unit[head]
            self.long_hash = mix((total[tail] - total[head]) * inverse[head])
        pair = np.flatnonzero(self.segment[1:] == self.segment[:-1]) if len(start) > 1 else np.empty(0, np.int64)
        self.pair_at = pair[~(self.masked[pair] | self.masked[pair + 1])] if len(pair) else pair
        with np.errstate(over="ignore"):
            self.pair = mix(self.word[self.pair_at] * np.uint64(BASE & MASK) + self.word[self.pair_at + 1]) if len(self.pair_at) else np.empty(0, np.uint64)


    def units(self, batch: Batch, words: np.ndarray) -> np.ndarray:
        """A number per line; lines that a narrow column broke have that of the line they go on from."""
        cp, n = batch.cp, len(batch.cp)
        solid = ~batch.has("space") & (cp != 0)
        last = np.maximum.accumulate(np.where(solid, np.arange(n), -1))[self.line_end]
        lead = solid & ~np.isin(cp, [ord(c) for c in ">/*"])
        head = np.minimum.accumulate(np.where(lead, np.arange(n), n - 1)[::-1])[::-1][self.line_start]
        small = batch.has("letter") & ~batch.has("upper")
        starts_small = small[head] & (head < self.line_end)
        self.is_sentence = (last >= self.line_start) & ((np.isin(cp[np.maximum(last, 0)], [ord(c) for c in ".!?…"]) & (words >= SENTENCE_WORDS)) | (words >= OPEN_SENTENCE_WORDS))
        is_open = (last >= self.line_start) & ~np.isin(cp[np.maximum(last, 0)], [ord(c) for c in ".!?:;…"]) & (words >= 3)
        goes_on = np.concatenate([[False], starts_small[1:] & is_open[:-1] & (cp[self.line_end[:-1]] == 10)])
        return np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(goes_on))))


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Row of each key in a sorted table, -1 where it has none."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def of_host(keys: np.ndarray, host: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys * np.uint64(BASE & MASK) + host)


def long_lines(page: Page, host: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key (of host and words) and page number of each long line."""
    doc = page.owner_of(page.line_start[page.long_unit])
    return of_host(page.long_hash, host[doc]), doc


def repeated_lines(pages: DataFrame) -> DataFrame:
    """(chunk, line): keys of the long lines that LEAST_PAGES pages of their host have."""

    def run(part: pa.Table) -> pa.Table:
        host, out = part["host"].to_numpy().view(np.uint64), []
        for first, _, batch in batches(texts_of(part["text"]), BATCH_CHARS):
            key, doc = long_lines(Page(batch), host[first:])
            once = np.unique(of_host(key, doc.astype(np.uint64)), return_index=True)[1]
            distinct, pages_with = np.unique(key[once], return_counts=True)
            out.append(pa.table({"chunk": pa.array(np.full(len(distinct), part["chunk"][0].as_py(), np.int64)), "line": pa.array(distinct.view(np.int64)), "pages": pa.array(pages_with.astype(np.int64))}))
        return pa.concat_tables(out)

    lines = checkpoint(pages.select("chunk", "host", "text").groupBy("chunk").applyInArrow(run, "chunk bigint, line bigint, pages bigint"))
    often = lines.groupBy("line").agg(F.sum("pages").alias("pages")).where(f"pages >= {LEAST_PAGES}").select("line")
    return lines.select("chunk", "line").distinct().join(often, "line").select("chunk", "line")


def count_features(pages: DataFrame) -> DataFrame:
    """(chunk, pair, feature): how often each word and pair of words of a chunk is in its short lines, and in its long lines that don't repeat."""

    def run(part: pa.Table, repeated: pa.Table) -> pa.Table:
        host, lines, out = part["host"].to_numpy().view(np.uint64), np.sort(repeated["line"].to_numpy().view(np.uint64)), []
        for first, _, batch in batches(texts_of(part["text"]), BATCH_CHARS):
            page = Page(batch)
            counts = np.ones(len(page.line_end), dtype=bool)
            counts[page.long_unit] = lookup(lines, long_lines(page, host[first:])[0]) < 0
            counts = counts[page.unit[page.line]]
            at, pair_at = np.flatnonzero(~page.masked & counts), counts[page.pair_at]
            for pair, at, keys in ((False, at, page.word[at]), (True, page.pair_at[pair_at], page.pair[pair_at])):
                distinct, back = np.unique(keys, return_inverse=True)
                short = np.bincount(back, weights=page.short[page.line[at]], minlength=len(distinct)).astype(np.int64)
                long = np.bincount(back, minlength=len(distinct)) - short
                out.append(pa.table({"chunk": pa.array(np.full(len(distinct), part["chunk"][0].as_py(), np.int64)), "pair": pa.array(np.full(len(distinct), pair)), "feature": pa.array(distinct.view(np.int64)), "short": pa.array(short), "long": pa.array(long)}))
        return pa.concat_tables(out)

    return pages.select("chunk", "host", "text").groupBy("chunk").cogroup(repeated_lines(pages).groupBy("chunk")).applyInArrow(run, "chunk bigint, pair boolean, feature bigint, short bigint, long bigint")


def weights(counts: DataFrame) -> DataFrame:
    """(pair, feature): log odds of short against long lines, of every feature seen LEAST times."""
    total = counts.groupBy("pair").agg(F.sum("short").alias("all_short"), F.sum("long").alias("all_long"))
    part = F.col("all_short") / F.greatest(F.col("all_short") + F.col("all_long"), F.lit(1))
    # PRIOR sightings in proportion to all short and long lines keep rare features near 0.
    short = F.log((F.col("short") + PRIOR * part + 1e-9) / F.greatest("all_short", F.lit(1)))
    odds = short - F.log((F.col("long") + PRIOR * (1 - part) + 1e-9) / F.greatest("all_long", F.lit(1)))
    each = counts.groupBy("pair", "feature").agg(F.sum("short").alias("short"), F.sum("long").alias("long")).where(f"short + long >= {LEAST}")
    return each.join(F.broadcast(total), "pair").select("pair", "feature", F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), odds)).alias("weight"))  # two rows


def chunk_features(pages: DataFrame) -> DataFrame:
    """(chunk, kind, feature, weight): of each chunk the words (kind 0) and pairs (kind 1) that have a weight."""
    counts = checkpoint(count_features(pages))
    return counts.select("chunk", "pair", "feature").distinct().join(weights(counts), ["pair", "feature"]).select("chunk", F.col("pair").cast("int").alias("kind"), "feature", "weight")


def tables_of(known: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and weights of each kind."""
    kind, key, weight = known["kind"].to_numpy(), known["feature"].to_numpy().view(np.uint64), known["weight"].to_numpy()
    out = []
    for k in (WORDS, PAIRS):
        at = np.flatnonzero(kind == k)
        at = at[np.argsort(key[at])]
        out.append((key[at], weight[at]))
    return out


def evidence(page: Page, words: tuple, pairs: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: sum of its features' log odds and how many features have one. A pair of words counts with its second."""
    n = len(page.word)
    row = np.where(page.masked, -1, lookup(words[0], page.word))
    single = np.where(row >= 0, words[1][np.maximum(row, 0)] if len(words[1]) else 0, np.nan)
    pair_row = lookup(pairs[0], page.pair)
    at = page.pair_at[pair_row >= 0]
    # A pair of words that both belong to running text says little by being new there.
    double = np.fmin(pairs[1][pair_row[pair_row >= 0]], np.fmax(single[at], single[at + 1]) + PAIR_GAIN) if len(at) else np.empty(0)
    total, known = np.nan_to_num(single), (row >= 0).astype(float)
    total[at + 1] += double
    known[at + 1] += 1
    if not n:
        return total, known
    return np.add.reduceat(total, page.token_at), np.add.reduceat(known, page.token_at)


def rows_of(column: pa.ChunkedArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All rows of a column of binary values, and the page of each."""
    values = column.to_pylist()
    size = np.fromiter((len(v) // kind.itemsize for v in values), dtype=np.int64, count=len(values))
    return np.frombuffer(b"".join(values), dtype=kind), np.repeat(np.arange(len(values)), size)


def packed(rows: np.ndarray, offsets: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * rows.itemsize).astype(np.int64)), pa.py_buffer(data.view(np.uint8))]).cast(pa.binary())


def layout(pages: DataFrame, features: DataFrame, keep: list[str]) -> DataFrame:
    """One row per page: chunk, host, page, the columns to keep, its entries and its lines."""

    def run(part: pa.Table, known: pa.Table) -> pa.Table:
        words, pairs = tables_of(known)
        out = []
        for first, last, batch in batches(texts_of(part["text"]), BATCH_CHARS):
            page = Page(batch)
            total, seen = evidence(page, words, pairs)
            opening = np.searchsorted(page.line_owner, np.arange(batch.n + 1))
            unit = page.unit[page.token_line]
            doc = page.line_owner[unit]
            entry = np.zeros(len(page.token), ENTRY)
            entry["token"], entry["line"], entry["odds"], entry["known"] = page.token, unit - opening[doc], total, np.minimum(seen, 65535)
            entry["size"] = np.minimum(np.diff(np.concatenate([page.token_at, [len(page.word)]])), 65535)
            line = np.zeros(len(page.line_end), LINE)
            line["unit"], line["solid"], line["sentence"] = page.unit - opening[page.line_owner], page.solid, page.is_sentence
            piece = part.slice(first, last - first)
            columns = [piece[c].combine_chunks() for c in ("chunk", "host", "page", *keep)]
            out.append(pa.Table.from_arrays([*columns, packed(entry, np.searchsorted(doc, np.arange(batch.n + 1))), packed(line, opening)], ["chunk", "host", "page", *keep, "entries", "lines"]))
        return pa.concat_tables(out) if out else pa.table({})

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.groupBy("chunk").cogroup(features.groupBy("chunk")).applyInArrow(run, f"chunk bigint, host bigint, page bigint, {kinds}, entries binary, lines binary")


def tokens(laid: DataFrame) -> DataFrame:
    """(chunk, key, role): of each token of a host its part of the occurrence vector, pages and evidence."""

    def run(part: pa.Table) -> pa.Table:
        entry, doc = rows_of(part["entries"], ENTRY)
        page_hash, host = (part[c].to_numpy().view(np.uint64) for c in ("page", "host"))
        key = of_host(entry["token"], host[doc])
        with np.errstate(over="ignore"):
            once = np.unique(mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        distinct, where, back = np.unique(key, return_index=True, return_inverse=True)
        prints = np.zeros(len(distinct), dtype=np.uint64)
        np.add.at(prints, back[once], mix(page_hash[doc[once]]))
        sums = (np.bincount(back, weights=entry[c], minlength=len(distinct)).astype(np.float32) for c in ("odds", "known"))
        return pa.table([
            pa.array(np.full(len(distinct), part["chunk"][0].as_py(), np.int64)), pa.array(host[doc[where]].view(np.int64)), pa.array(distinct.view(np.int64)), pa.array(prints.view(np.int64)),
            pa.array(np.bincount(back[once], minlength=len(distinct)).astype(np.int32)), *map(pa.array, sums), pa.array(entry["size"][where] > 1),
        ], ["chunk", "host", "key", "vector", "pages", "odds", "known", "long"])

    return laid.select("chunk", "host", "page", "entries").groupBy("chunk").applyInArrow(run, "chunk bigint, host bigint, key bigint, vector bigint, pages int, odds float, known float, long boolean")


def deduce(seen: DataFrame) -> DataFrame:
    """(key, class, odds, known, pages, own): each frequent token with its equivalence class.

    A class is the tokens of one host, of short or of long lines, with the same vector; own is the evidence of the token alone.
    """
    wrapped = F.sum(F.col("vector").cast("decimal(38,0)"))  # a sum that can't overflow; equal vectors have equal sums
    each = seen.groupBy("key").agg(F.first("host").alias("host"), F.first("long").alias("long"), wrapped.alias("vector"), F.sum("pages").alias("pages"), F.sum("odds").alias("odds"), F.sum("known").alias("known"))
    return each.where(f"pages >= {LEAST_PAGES}").select("key", F.xxhash64("host", "long", "vector", "pages").alias("class"), "odds", "known", "pages", F.coalesce(F.try_divide("odds", "known"), F.lit(float("nan"))).alias("own"))


def orders(laid: DataFrame, frame: DataFrame) -> DataFrame:
    """(class, parent): in how many pages parent stands around class (0: none), and hashes of the orders of the class's tokens."""

    def run(part: pa.Table, known: pa.Table) -> pa.Table:
        entry, doc = rows_of(part["entries"], ENTRY)
        host = part["host"].to_numpy().view(np.uint64)
        table = known.sort_by("key")
        keys = of_host(entry["token"], host[doc])
        signed = table["key"].to_numpy()
        row = lookup(signed, keys.view(np.int64))
        at = np.flatnonzero(row >= 0)
        names = table["class"].to_numpy()[row[at]]
        owner = doc[at]
        # First places of tokens, by page and class, in order.
        order = np.lexsort((np.arange(len(at)), keys[at], owner))
        fresh = np.concatenate([[True], (keys[at][order][1:] != keys[at][order][:-1]) | (owner[order][1:] != owner[order][:-1])]) if len(at) else np.empty(0, bool)
        firsts = np.sort(order[fresh])
        group = np.lexsort((firsts, names[firsts], owner[firsts]))
        firsts = firsts[group]
        new = np.concatenate([[True], (names[firsts][1:] != names[firsts][:-1]) | (owner[firsts][1:] != owner[firsts][:-1])]) if len(firsts) else np.empty(0, bool)
        edge = np.flatnonzero(new)
        if not len(edge):
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())], ["class", "parent", "pages", "low", "high"])
        rank = np.arange(len(firsts)) - np.repeat(edge, np.diff(np.concatenate([edge, [len(firsts)]])))
        power, _ = powers(len(firsts) + 1)
        with np.errstate(over="ignore"):
            sequence = mix(np.add.reduceat(mix(keys[at][firsts]) * power[rank], edge)).view(np.int64)
        of_class, of_page = names[firsts[edge]], owner[firsts[edge]]
        # The lines from its first to its last token; the parent is the latest to begin of those that reach around.
        line, bounds = entry["line"][at], np.concatenate([firsts[edge][:, None], np.zeros((len(edge), 1), np.int64)], axis=1)
        last = np.zeros(len(edge), np.int64)
        slot = {(p, c): i for i, (p, c) in enumerate(zip(of_page.tolist(), of_class.tolist()))}
        place = np.fromiter((slot[k] for k in zip(owner.tolist(), names.tolist())), np.int64, len(at))
        np.maximum.at(last, place, line.astype(np.int64))
        begin = line[bounds[:, 0]].astype(np.int64)
        parent = np.zeros(len(edge), np.int64)
        starts = np.searchsorted(of_page, np.arange(len(host) + 1))
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a > 1:
                outer = np.flatnonzero(last[a:b] > begin[a:b])
                if len(outer):
                    around = (begin[a:b][outer][None, :] < begin[a:b, None]) & (last[a:b][outer][None, :] > last[a:b, None])
                    best = np.where(around, begin[a:b][outer][None, :], -1)
                    pick = best.argmax(axis=1)
                    parent[a:b] = np.where(best.max(axis=1) >= 0, of_class[a:b][outer][pick], 0)
        pair, back = np.unique(np.stack([of_class, parent], axis=1), axis=0, return_inverse=True)
        low, high = np.full(len(pair), np.iinfo(np.int64).max), np.full(len(pair), np.iinfo(np.int64).min)
        np.minimum.at(low, back.ravel(), sequence)
        np.maximum.at(high, back.ravel(), sequence)
        return pa.table([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1])), pa.array(np.bincount(back.ravel()).astype(np.int64)), pa.array(low), pa.array(high)], ["class", "parent", "pages", "low", "high"])

    each = laid.select("chunk", "host", "entries").groupBy("chunk").cogroup(frame.select("chunk", "key", "class").groupBy("chunk")).applyInArrow(run, "class bigint, parent bigint, pages bigint, low bigint, high bigint")
    return each.groupBy("class", "parent").agg(F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"))


def template(tokens_of: DataFrame, seen: DataFrame) -> DataFrame:
    """(key, weight): each token of a host's classes with the weight of its class, which its parent moves.

    tokens_of are deduce()'s rows, seen are those of orders(). The tokens of a class without one order weigh what they weigh alone.
    """
    nested = seen.groupBy("class").agg((F.min("low") == F.max("high")).alias("ordered"), F.max_by("parent", F.struct("pages", "parent")).alias("parent"), F.max("pages").alias("with_parent"), F.sum("pages").alias("all"))
    nested = nested.select("class", "ordered", F.when((F.col("with_parent") * 2 > F.col("all")) & (F.col("parent") != 0), F.col("parent")).alias("parent"))
    weighed = tokens_of.groupBy("class").agg(F.try_divide(F.sum("odds"), F.sum("known")).alias("weight"))
    above = weighed.select(F.col("class").alias("parent"), F.greatest(F.lit(-NEST_LIMIT), F.least(F.lit(NEST_LIMIT), F.col("weight"))).alias("lean"))
    classes = weighed.join(nested, "class", "left").join(above, "parent", "left").select("class", "weight", F.coalesce("ordered", F.lit(True)).alias("ordered"), (NEST * F.coalesce("lean", F.lit(0.0))).alias("lean"))
    rows = tokens_of.join(classes, "class").select("key", (F.when(F.col("ordered"), F.col("weight")).otherwise(F.nanvl("own", F.lit(None).cast("double"))) + F.col("lean")).alias("weight"))
    return rows.where("weight is not null")


def mean_of(unit: np.ndarray, total: np.ndarray, amount: np.ndarray, n: int) -> np.ndarray:
    amount = np.bincount(unit, weights=amount, minlength=n)
    return np.divide(np.bincount(unit, weights=total, minlength=n), amount, out=np.full(n, np.nan), where=amount > 0)


def judge(entry: np.ndarray, unit: np.ndarray, line: np.ndarray, weight: np.ndarray, own_unit: np.ndarray, page: np.ndarray, threshold: float, sentence_threshold: float) -> np.ndarray:
    """Whether each line is furniture: entries with the unit of each and the weight of its class (NaN: none), lines with their unit and page."""
    n = len(line)
    known = ~np.isnan(weight)
    score = mean_of(unit, np.where(known, weight, 0) * entry["size"], known * entry["size"], n)[own_unit]
    cover = np.nan_to_num(mean_of(unit, known * entry["size"].astype(float), entry["size"].astype(float), n))[own_unit]
    own = np.nan_to_num(mean_of(unit, entry["odds"].astype(float), entry["known"].astype(float), n))[own_unit]
    least = np.where(line["sentence"], sentence_threshold, threshold)
    solid = line["solid"]
    fixed = solid & (np.nan_to_num(score, nan=-9.0) >= least) & (cover >= COVER)
    slot = solid & ~fixed & (cover < COVER)
    at = np.flatnonzero(solid)
    same = np.diff(page[at]) == 0
    hit = fixed.copy()
    edge = np.ones((2, len(at)), dtype=bool)
    edge[0, 1:], edge[1, :-1] = ~same, ~same
    for _ in range(SLOT_ROUNDS):
        near = np.zeros((2, len(at)), dtype=bool)
        near[0, 1:], near[1, :-1] = same & hit[at][:-1], same & hit[at][1:]
        sides = (near | edge).sum(axis=0)
        new = slot[at] & near.any(axis=0) & (own[at] + BOUND * (sides - 1) >= least[at] - SLOT)
        if np.array_equal(new, hit[at] & slot[at]):
            break
        hit[at] = fixed[at] | new
    return hit


def furniture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", threshold: float = THRESHOLD, sentence_threshold: float = SENTENCE_THRESHOLD, body: bool = True) -> DataFrame:
    """One row per page with text: id, furniture (sorted numbers of its furniture lines, from 1) and, if wanted, body (the text without them).

    A page with null text gives no row; a null host is a host of its own; blank lines are never
    furniture. Repeated rows are pages of their own. Columns other than the three named aren't read.
    """
    pages = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))).alias("host"), F.xxhash64(F.col(id_col)).alias("page")).where("text is not null")
    kind = pages.schema["id"].dataType.simpleString()
    chunks = 1 + (pages.agg(F.sum(F.length("text"))).first()[0] or 0) // CHUNK_CHARS
    pages = pages.withColumn("chunk", F.pmod(F.xxhash64("page", "text"), F.lit(chunks)))
    # Weights and classes are looked up by joins, so that no table of words or tokens has to fit a machine.
    features = chunk_features(pages)
    laid = checkpoint(layout(pages, features, ["id", "text"] if body else ["id"]))
    seen = checkpoint(tokens(laid))
    classed = checkpoint(deduce(seen))
    there = seen.select("chunk", "key")
    order = orders(laid, there.join(classed.select("key", "class"), "key"))
    frame = there.join(template(classed, order), "key")

    def run(part: pa.Table, known: pa.Table) -> pa.Table:
        table = known.sort_by("key")
        entry, doc = rows_of(part["entries"], ENTRY)
        line, page = rows_of(part["lines"], LINE)
        opening = np.searchsorted(page, np.arange(part.num_rows + 1))
        row = lookup(table["key"].to_numpy(), of_host(entry["token"], part["host"].to_numpy().view(np.uint64)[doc]).view(np.int64))
        weight = np.where(row >= 0, table["weight"].to_numpy()[np.maximum(row, 0)], np.nan) if table.num_rows else np.full(len(entry), np.nan)
        hit = np.flatnonzero(judge(entry, entry["line"] + opening[doc], line, weight, line["unit"] + opening[page], page, threshold, sentence_threshold))
        offsets = np.searchsorted(page[hit], np.arange(part.num_rows + 1))
        number = hit - opening[page[hit]]
        columns = {"id": part["id"], "furniture": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((number + 1).astype(np.int32)))}
        if body:
            bodies = []
            for i, text in enumerate(part["text"].to_pylist()):
                gone = set(number[offsets[i] : offsets[i + 1]].tolist())
                bodies.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone) if gone else text)
            columns["body"] = pa.array(bodies, pa.string())
        return pa.table(columns)

    taken = laid.select("chunk", "host", "id", *(["text"] if body else []), "entries", "lines")
    marked = taken.groupBy("chunk").cogroup(frame.groupBy("chunk")).applyInArrow(run, f"id {kind}, furniture array<int>" + (", body string" if body else ""))
    return marked.withColumnRenamed("id", id_col)
