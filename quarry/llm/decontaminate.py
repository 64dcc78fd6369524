"""Benchmark decontamination with an FM-index per shard of training text.

Each shard (a bounded block of whole documents) is cut into words; a word outside the benchmark's vocabulary can be
in no window and acts as a separator, so the index alphabet is the benchmark vocabulary. Runs shorter than the
shortest window are left out of the index (they hold no occurrence). The index is a suffix array (prefix doubling),
its Burrows-Wheeler string in a wavelet matrix, and sampled suffix positions. Windows are looked up by their rarest word,
and those whose words the shard holds are searched backwards; their rows are located by LF steps to a sampled position, and the
covered words are merged into removal spans.

There is no shuffle: a shard needs nothing but the benchmark's windows, which are sent to the executors. Their size is
summed first: up to `max_benchmark_bytes` of text is one block of items, more is as many blocks (items dealt by the hash
of their id), each searched in a pass of its own over the documents, whose hits are merged. So any benchmark is searched
whole, and the driver holds one block at a time.

Defined cases: null or word-less text has no words and no hits; a null or word-less item, or one without id, has no window; an
empty benchmark hits nothing and empty documents give an empty result; repeated items count once for each item_id; repeated
rows are each scanned on their own; an item of fewer than `window` words is one window; windows of several items (ties) name all of
them; very long texts are shards of their own and taken whole. Only `doc_id` and `text` are read, so other columns may
carry any name. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common as C

WINDOW = 10
SAMPLE_RATE = 16
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_spans long"


class Windows:
    """The benchmark's distinct windows as vocabulary ids, and the items that hold each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        text = pa.array([t.decode("utf-8", "replace") for _, t in items], pa.string())
        data, off = C.text_bytes(text)
        data = C.LOWER[data]
        starts, ends = C.word_bounds(data, off, C.ALNUM)
        hashes = C.span_hashes(data, starts, ends)
        self.vocab, ids = np.unique(hashes, return_inverse=True)
        first = np.searchsorted(starts, off)
        found: dict[tuple, set[str]] = {}
        for k, (item, _) in enumerate(items):
            own = ids[first[k] : first[k + 1]] + 1
            for j in range(max(1, own.size - window + 1) if own.size else 0):
                found.setdefault(tuple(own[j : j + window].tolist()), set()).add(item)
        keys = list(found)
        self.length = np.array([len(k) for k in keys], np.int64)
        self.symbols = np.zeros((len(keys), window), np.int64)
        for k, key in enumerate(keys):
            self.symbols[k, : len(key)] = key
        self.names = sorted({i for s in found.values() for i in s})
        at = {n: i for i, n in enumerate(self.names)}
        lists = [sorted(at[i] for i in found[k]) for k in keys]
        self.item_off = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))).astype(np.int64)
        self.item_of = np.array([i for x in lists for i in x], np.int64)
        self.shortest = int(self.length.min()) if keys else 0
        often = np.bincount(self.symbols[self.symbols > 0], minlength=self.vocab.size + 1)
        used = np.arange(window)[None, :] < self.length[:, None]
        rarest = np.take_along_axis(self.symbols, np.where(used, often[self.symbols], np.iinfo(np.int64).max).argmin(axis=1)[:, None], axis=1)[:, 0] if keys else np.zeros(0, np.int64)
        self.by_rarest = np.argsort(rarest, kind="stable")  # windows by the word that the fewest windows hold
        self.rarest_off = np.searchsorted(rarest[self.by_rarest], np.arange(self.vocab.size + 2))

    def possible(self, present: np.ndarray) -> np.ndarray:
        """The windows all of whose words are present; present: a flag for each vocabulary id + 1."""
        words = np.flatnonzero(present[1:]) + 1
        lo, n = self.rarest_off[words], self.rarest_off[words + 1] - self.rarest_off[words]
        own = self.by_rarest[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return np.sort(own[(present | (np.arange(present.size) == 0))[self.symbols[own]].all(axis=1)])


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; a zero is a separator and differs from every other separator."""
    n = symbols.size
    zero = symbols == 0
    rank = symbols + int(zero.sum())
    rank[zero] = np.arange(int(zero.sum()))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    step, order = 1, np.argsort(rank, kind="stable")
    while step < n:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:]
        key = rank * (n + 1) + ahead + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


class FMIndex:
    """Counts and locates windows in a string of symbols (0: separator, first and last symbol)."""

    def __init__(self, symbols: np.ndarray, sigma: int, rate: int = SAMPLE_RATE):
        n = self.n = symbols.size
        sa = suffix_array(symbols)
        bwt = symbols[sa - 1]
        self.levels = max(1, int(sigma).bit_length())
        self.ones, self.bits, self.zeros = [], [], []
        now = bwt
        for level in reversed(range(self.levels)):
            bit = ((now >> level) & 1).astype(bool)
            self.bits.append(bit)
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int64))
            self.zeros.append(n - int(bit.sum()))
            now = np.concatenate((now[~bit], now[bit]))
        counts = np.bincount(symbols, minlength=sigma + 1)
        self.before = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.starts = self._walk(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))
        at_start = symbols[sa - 1] == 0
        marked = (sa % rate == 0) | at_start
        self.marked = marked
        self.mark_rank = np.concatenate(([0], np.cumsum(marked)))
        self.samples = sa[marked]

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        i = i.copy()
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            up = ones[i]
            i = np.where((c >> level) & 1, zeros + up, i - up)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] is among the first i[k] symbols of the Burrows-Wheeler string."""
        return self._walk(c, i) - self.starts[c]

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the windows, all searched backwards side by side."""
        low, high = np.zeros(length.size, np.int64), np.full(length.size, self.n, np.int64)
        live = np.arange(length.size)
        for back in range(1, symbols.shape[1] + 1):
            live = live[length[live] >= back]
            c = symbols[live, length[live] - back]
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
            dead = live[low[live] >= high[live]]
            high[dead] = low[dead]
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by LF steps to a sampled row."""
        out, steps = np.empty(rows.size, np.int64), 0
        row, left = rows.copy(), np.arange(rows.size)
        while left.size:
            there = self.marked[row]
            out[left[there]] = self.samples[self.mark_rank[row[there]]] + steps
            row, left = row[~there], left[~there]
            c, i = np.zeros(row.size, np.int64), row.copy()
            for level, bits, ones, zeros in zip(reversed(range(self.levels)), self.bits, self.ones, self.zeros, strict=True):
                bit, up = bits[i], ones[i]
                c |= bit.astype(np.int64) << level
                i = np.where(bit, zeros + up, i - up)
            row = self.before[c] + i - self.starts[c]
            steps += 1
        return out


def shard_hits(ids: np.ndarray, doc_first: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, window numbers, lengths) of all occurrences in a shard; ids: vocabulary id + 1 of each word or 0."""
    none = np.zeros(0, np.int64)
    if not ids.size or not w.length.size:
        return none, none, none
    known = ids > 0
    edge = np.zeros(ids.size + 1, bool)
    edge[doc_first] = True
    first = np.flatnonzero(known & (np.concatenate(([True], ~known[:-1])) | edge[:-1]))
    last = np.flatnonzero(known & (np.concatenate((~known[1:], [True])) | edge[1:])) + 1
    long = last - first >= w.shortest
    first, last = first[long], last[long]
    if not first.size:
        return none, none, none
    size = last - first
    to = np.concatenate(([1], 1 + np.cumsum(size + 1)))  # each run is followed by a separator
    symbols = np.zeros(int(to[-1]), np.int64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    source = np.repeat(first, size) + inner
    target = np.repeat(to[:-1], size) + inner
    symbols[target] = ids[source]
    origin = np.zeros(symbols.size, np.int64)
    origin[target] = source
    present = np.zeros(w.vocab.size + 1, bool)
    present[symbols] = True
    present[0] = False
    able = w.possible(present)
    if not able.size:
        return none, none, none
    fm = FMIndex(symbols, int(w.vocab.size))
    low, high = np.zeros(w.length.size, np.int64), np.zeros(w.length.size, np.int64)
    low[able], high[able] = fm.search(w.symbols[able], w.length[able])
    count = high - low
    hit = np.flatnonzero(count)
    if not hit.size:
        return none, none, none
    words, windows = [], []
    for part in np.array_split(hit, max(1, int(count.sum() // 2_000_000) + 1)):
        n = count[part]
        rows = np.repeat(low[part], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        words.append(origin[fm.locate(rows)])
        windows.append(np.repeat(part, n))
    at, which = np.concatenate(words), np.concatenate(windows)
    return at, which, w.length[which]


class Scan:
    """What a block of documents holds of one or more blocks of windows."""

    def __init__(self, col: pa.Array):
        data, self.off = C.text_bytes(col)
        data = C.LOWER[data]
        self.starts, self.ends = C.word_bounds(data, self.off, C.ALNUM)
        self.doc_first = np.searchsorted(self.starts, self.off)
        self.n_words = np.diff(self.doc_first)
        self.hashes = C.span_hashes(data, self.starts, self.ends)
        self.depth = np.zeros(self.starts.size + 1, np.int64)
        self.items: dict[int, list[str]] = {}

    def add(self, w: Windows) -> None:
        """Searches the windows of w."""
        if not (w.vocab.size and self.starts.size):
            return
        at = np.minimum(np.searchsorted(w.vocab, self.hashes), w.vocab.size - 1)
        first, which, length = shard_hits(np.where(w.vocab[at] == self.hashes, at + 1, 0), self.doc_first, w)
        if not first.size:
            return
        np.add.at(self.depth, first, 1)
        np.add.at(self.depth, first + length, -1)
        pairs = np.unique((np.searchsorted(self.doc_first, first, "right") - 1) * w.length.size + which)
        doc, win = pairs // w.length.size, pairs % w.length.size
        n = w.item_off[win + 1] - w.item_off[win]
        item = w.item_of[np.repeat(w.item_off[win] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        for x in np.unique(np.repeat(doc, n) * len(w.names) + item).tolist():
            self.items.setdefault(x // len(w.names), []).append(w.names[x % len(w.names)])

    def cover(self, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Marks the words of byte spans found before."""
        np.add.at(self.depth, np.searchsorted(self.starts, self.off[doc] + begin), 1)
        np.add.at(self.depth, np.searchsorted(self.starts, self.off[doc] + end), -1)

    def hits(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(hit words of each document, merged spans as (document, first byte, end byte))."""
        covered = np.cumsum(self.depth[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(covered)))
        edge = np.zeros(covered.size + 1, bool)
        edge[self.doc_first] = True
        new = covered & (np.concatenate(([True], ~covered[:-1])) | edge[:-1]) if covered.size else covered
        end = covered & (np.concatenate((~covered[1:], [True])) | edge[1:]) if covered.size else covered
        a, b = np.flatnonzero(new), np.flatnonzero(end)
        doc = np.searchsorted(self.doc_first, a, "right") - 1
        return total[self.doc_first[1:]] - total[self.doc_first[:-1]], (doc, self.starts[a] - self.off[doc], self.ends[b] - self.off[doc])


def scan(col: pa.Array, w: Windows):
    """Per document of a shard: words, hits, items; and the merged spans as (document, first byte, end byte)."""
    found = Scan(col)
    found.add(w)
    n_hit, spans = found.hits()
    return found.n_words, n_hit, found.items, spans


MAX_BENCHMARK_BYTES = 64 << 20  # of benchmark text in one block
SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def windows_of(benchmark: DataFrame, window: int = WINDOW, max_benchmark_bytes: int = MAX_BENCHMARK_BYTES):
    """The benchmark's windows, block by block (one at least)."""
    from pyspark.sql import functions as F

    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("string").alias("i"), "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = 1 if size <= max_benchmark_bytes else -(-2 * size // max_benchmark_bytes)
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        yield Windows(sorted((r["i"], r["text"].encode()) for r in own.collect()), window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_benchmark_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """One row per document: counts, the items found (list and digest) and the merged removal spans in bytes."""
    from pyspark.sql import functions as F

    def passing(w: Windows, last: bool):
        def run(batches):
            for block in C.blocks(batches):
                found = Scan(block.column(1))
                before, spans = block.column(2).to_pylist(), block.column(3).to_pylist()
                at = [(k, s["begin"], s["end"]) for k, own in enumerate(spans) for s in own]
                if at:
                    found.cover(*np.array(at, np.int64).T)
                found.add(w)
                n_hit, (doc, a, b) = found.hits()
                names = [sorted({*before[k], *found.items.get(k, [])}) for k in range(block.num_rows)]
                cut = np.searchsorted(doc, np.arange(block.num_rows + 1))
                spans = [[{"begin": int(x), "end": int(y)} for x, y in zip(a[s:e], b[s:e], strict=True)] for s, e in zip(cut[:-1], cut[1:], strict=True)]
                text = pa.nulls(block.num_rows, pa.string()) if last else block.column(1)
                yield pa.RecordBatch.from_arrays([block.column(0), text, pa.array(names, pa.list_(pa.string())), pa.array(spans, SPANS), pa.array(found.n_words), pa.array(n_hit)], ["doc_id", "text", "items", "spans", "n_words", "n_hit"])

        return run

    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<begin:long,end:long>>").alias("spans"))
    blocks = windows_of(benchmark, window, max_benchmark_bytes)
    w = next(blocks)
    while w is not None:
        then = next(blocks, None)
        out = out.select("doc_id", "text", "items", "spans").mapInArrow(passing(w, then is None), "doc_id long, text string, items array<string>, spans array<struct<begin:long,end:long>>, n_words long, n_hit long")
        out, w = out if then is None else C.cut(out), then
    return out.select("doc_id", "n_words", "n_hit", "items", "spans")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_benchmark_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """The same rows with every hit word span cut out of `text` (a line break stands for it), again until none is left.

    Documents without a hit pass unchanged, and n_chars, where present, is brought up to date for those that change.
    All other columns pass as they are. Of a benchmark of several blocks, each is cut out in turn, until a round over all of
    them finds nothing (a line break ends no window, so a cut can bring words of another block's window together)."""
    import pyarrow.compute  # noqa: F401

    blocks = windows_of(benchmark, window, max_benchmark_bytes)
    out, w, then = docs, next(blocks), next(blocks, None)
    if then is None:
        return _cut_out(out, w)
    while True:
        for w in windows_of(benchmark, window, max_benchmark_bytes):
            out = C.cut(_cut_out(out, w))
        if not decontaminate(out, benchmark, window, max_benchmark_bytes).where("n_hit > 0").take(1):
            return out


def _cut_out(docs: DataFrame, w: Windows) -> DataFrame:
    """remove_spans for one block of windows."""
    names = docs.columns

    def run(batches):
        for block in C.blocks(batches):
            col = block.column(names.index("text"))
            _, n_hit, _, spans = scan(col, w)
            changed = {}
            left = np.flatnonzero(n_hit)
            texts = [col[int(k)].as_py().encode() for k in left]
            while left.size:
                doc, a, b = spans
                if not changed:
                    doc = np.searchsorted(left, doc)
                for k in reversed(range(len(doc))):
                    t = texts[doc[k]]
                    texts[doc[k]] = t[: a[k]] + b"\n" + t[b[k] :]
                changed |= {int(k): t.decode("utf-8", "replace") for k, t in zip(left, texts, strict=True)}
                _, again, _, (doc, a, b) = scan(pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()), w)
                stay = np.flatnonzero(again)
                spans = (np.searchsorted(stay, doc), a, b)
                left, texts = left[stay], [texts[k] for k in stay]
            if changed:
                new = [changed.get(k, None) for k in range(block.num_rows)]
                hit = pa.array([k in changed for k in range(block.num_rows)])
                cols = [pa.compute.if_else(hit, pa.array(new, col.type), c) if n == "text" else c for n, c in zip(names, block.columns, strict=True)]
                if "n_chars" in names:
                    k = names.index("n_chars")
                    cols[k] = pa.compute.if_else(hit, pa.compute.utf8_length(pa.array(new, col.type)).cast(cols[k].type), cols[k])
                block = pa.RecordBatch.from_arrays(cols, schema=block.schema)
            yield block

    return docs.mapInArrow(run, docs.schema)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("spans").cast("long").alias("n_spans"),
    )


def brute(texts: dict, items: dict, window: int = WINDOW) -> dict:
    """Reference by plain loops: doc_id -> (n_words, n_hit, items digest). For tests."""
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    wins = {}
    for i, t in items.items():
        w = words(t)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[j : j + window]), set()).add(str(i))
    out = {}
    for d, t in texts.items():
        w, hit, got = words(t), set(), set()
        for key, ids in wins.items():
            for j in range(len(w) - len(key) + 1):
                if tuple(w[j : j + len(key)]) == key:
                    hit |= set(range(j, j + len(key)))
                    got |= ids
        out[d] = (len(w), len(hit), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest())
    return out
