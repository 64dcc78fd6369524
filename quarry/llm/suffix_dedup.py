"""Removal of repeated byte strings with suffix arrays sorted by the deep-shallow method.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. All steps are
one plan of exchanges whose rows are packed arrays, so no key, however frequent, is more than an entry per task:
1. Anchors: in every LENGTH-byte string the ANCHOR-byte substrings with the least hash (minimizers) are anchors; equal
   strings hold equal anchors, and about one position in 14 is one. A task sends each distinct anchor hash once, with its
   document, or as known to repeat (then it needs no answer), to the bucket of the hash; buckets answer to the shards
   (doc_id modulo a prime) which anchors repeat anywhere.
2. A shard takes the texts of its documents, and for each repeated anchor the context: the bytes of all LENGTH-byte
   strings with this minimum. Of equal contexts only the smallest document asks on; the others are decided at once.
3. A bucket of contexts sorts the suffixes that start in them, to LENGTH bytes: multikey quicksort, 8 bytes being one
   character, to SHALLOW bytes, then blind tries for the groups whose common prefix is longer. Strings that end in one
   leaf of a trie are the equal strings of the corpus; the smallest document of each keeps its own, the others get
   removal spans.
4. The shards merge all spans per row (the exchange of their texts is used again) and cut them out.

The hashes of steps 1 and 2 only choose what is compared: contexts of one hash are compared byte by byte before they count
as equal, and equal strings are those that the sort and the tries put together. Shards are SHARD_BYTES large, and larger
with the square root of the input beyond ROOT_BYTES, so that the rows between shards and buckets stay packed.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; very long texts are one shard's work and taken
whole; a null doc_id takes no part (nothing is removed there, nor because of it); rows that repeat a doc_id are one
document to the rule, but each row is cut by its own spans (rows equal in id and text are cut alike); ties cannot arise, the
smallest doc_id being one number; spans may cut a character, so the kept bytes are binary; an empty table gives an empty
result. Only doc_id and text are read, so further columns may carry any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common as C

LENGTH, ANCHOR, SHALLOW = 50, 24, 24
SHARD_BYTES, ROOT_BYTES = 6 << 20, 32 << 30
FLUSH = 1_000_000  # anchors that a task gathers before it sends them
_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)


def pack(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.dtype.char.encode() + a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    kind = np.dtype(raw[:1].decode())
    return np.frombuffer(raw, np.uint8, offset=1).reshape(kind.itemsize, -1).T.copy().view(kind).reshape(-1)


def joined(column, kind) -> np.ndarray:
    return np.concatenate([unpack(b) for b in column] or [np.zeros(0, kind)]).astype(kind, copy=False)


def sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w consecutive entries (length len(a) - w + 1)."""
    done, out = 1, a
    while done * 2 <= w:
        out = op(out[: out.size - done], out[done:])
        done *= 2
    if done < w:
        out = op(out[: out.size - (w - done)], out[w - done :])
    return out


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = ANCHOR):
    """(place, hash, first string, last string) of each anchor: the strings data[s:s+length] that have it as minimum."""
    n, w = data.size, length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, np.zeros(0, _U), none, none
    places = np.arange(n - k + 1)
    h = C.span_hashes(data, places, places + k)
    h = np.minimum(h, _TOP - _U(1))
    m = sliding(h, w, np.minimum)  # by first byte of the string
    valid = np.ones(n + 1, bool)  # strings that stay in their document
    edge = np.zeros(n + length + 1, np.int32)
    inner = off[1:-1]
    np.add.at(edge, np.maximum(inner - length + 1, 0), 1)
    np.add.at(edge, inner, -1)
    valid = (np.cumsum(edge[: m.size]) == 0)
    m = np.where(valid, m, _U(0))
    # place i is an anchor if a string that holds it has its hash as minimum
    padded = np.concatenate((np.zeros(w - 1, _U), m, np.zeros(w - 1, _U)))[: h.size + w - 1]
    is_anchor = sliding(padded, w, np.maximum) == h
    at = np.flatnonzero(is_anchor)
    hash_at = h[at]
    first = np.full(at.size, -1, np.int64)
    last = np.full(at.size, -1, np.int64)
    for back in range(w - 1, -1, -1):
        s = at - back
        ok = (s >= 0) & (s < m.size)
        hit = np.zeros(at.size, bool)
        hit[ok] = m[s[ok]] == hash_at[ok]
        first = np.where(hit & (first < 0), s, first)
        last = np.where(hit, s, last)
    return at, C.mix(hash_at + _U(0x5DEECE66D)), first, last  # minima are small: mixed again, they spread over all buckets


def _ask(n_buckets: int, n_shards: int):
    """Step 1, per task: (bucket, kind, shard, docs, hashes); kind 0 asks, 1 is an answer already, 2 repeats for sure."""

    def rows(hs, ds):
        h, d = np.concatenate(hs), np.concatenate(ds)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        new = np.ones(h.size, bool)
        new[1:] = h[1:] != h[:-1]
        other = np.zeros(h.size, bool)
        other[1:] = ~new[1:] & (d[1:] != d[:-1])
        group = np.cumsum(new) - 1
        multi = np.bincount(group, other, group[-1] + 1) > 0
        start = np.flatnonzero(new)
        bucket = np.minimum((h[start] >> _U(32)) * _U(n_buckets) >> _U(32), _U(n_buckets - 1)).astype(np.int64)
        for kind, pick in ((0, ~multi), (2, multi)):
            s, b = start[pick], bucket[pick]
            cut = np.searchsorted(b, np.arange(n_buckets + 1))
            for k in np.flatnonzero(np.diff(cut)):
                part = s[cut[k] : cut[k + 1]]
                yield k, kind, -1, pack(d[part]) if kind == 0 else b"", pack(h[part])
        known = multi[group]
        if known.any():
            yield from answers(d[known], h[known])

    def answers(d, h):
        shard = d % n_shards
        order = np.argsort(shard, kind="stable")
        d, h, shard = d[order], h[order], shard[order]
        cut = np.searchsorted(shard, np.arange(n_shards + 1))
        for k in np.flatnonzero(np.diff(cut)):
            yield int(k) % n_buckets, 1, int(k), pack(d[cut[k] : cut[k + 1]]), pack(h[cut[k] : cut[k + 1]])

    def batch(items):
        items = list(items)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in items], pa.int64()), pa.array([x[1] for x in items], pa.int32()), pa.array([x[2] for x in items], pa.int64()), pa.array([x[3] for x in items], pa.binary()), pa.array([x[4] for x in items], pa.binary())], ["bucket", "kind", "shard", "docs", "hashes"])

    def ask(batches):
        hs, ds, n = [], [], 0
        for block in C.blocks(batches, 1 << 20):
            data, off = C.text_bytes(block.column(1))
            at, h, _, _ = anchors(data, off)
            ids = np.asarray(block.column(0), dtype=np.int64)
            hs.append(h)
            ds.append(ids[np.searchsorted(off, at, "right") - 1])
            n += at.size
            if n > FLUSH:
                yield batch(rows(hs, ds))
                hs, ds, n = [], [], 0
        if n:
            yield batch(rows(hs, ds))

    def answer(table):
        kind = np.asarray(table["kind"])
        docs, hashes, shard = table["docs"].to_pylist(), table["hashes"].to_pylist(), table["shard"].to_pylist()
        items = [(0, 1, shard[k], docs[k], hashes[k]) for k in np.flatnonzero(kind == 1)]
        h0 = [unpack(hashes[k]) for k in np.flatnonzero(kind == 0)]
        if h0:
            d0 = np.concatenate([unpack(docs[k]) for k in np.flatnonzero(kind == 0)])
            h2 = joined([hashes[k] for k in np.flatnonzero(kind == 2)], _U)
            h0 = np.concatenate(h0)
            h = np.concatenate((h0, h2))
            order = np.argsort(h)
            s = h[order]
            same = np.zeros(h.size, bool)
            same[1:] = s[1:] == s[:-1]
            same[:-1] |= s[1:] == s[:-1]
            hit = order[same]
            hit = np.sort(hit[hit < h0.size])
            items += answers(d0[hit], h0[hit]) if hit.size else []
        out = batch(items)
        return pa.Table.from_batches([out.select(["shard", "docs", "hashes"])])

    return ask, answer


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places start, start + 1, ... of ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def same_bytes(data: np.ndarray, at: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[at:at+size] equals data[to:to+size], for each entry; sizes are above 0."""
    out = np.ones(at.size, bool)
    for part in np.array_split(np.arange(at.size), max(1, int(size.sum()) >> 22)):
        if part.size:
            n = size[part]
            apart = data[ragged(at[part], n)] != data[ragged(to[part], n)]
            out[part] = ~np.logical_or.reduceat(apart, np.cumsum(n) - n)
    return out


def equal_contexts(data: np.ndarray, begin: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The class of each context: equal hashes whose bytes are equal too."""
    left, out, classes = np.arange(h.size), np.zeros(h.size, np.int64), 0
    while left.size:
        _, first, group = np.unique(h[left], return_index=True, return_inverse=True)
        head = left[first][group]
        ok = (size[left] == size[head])
        ok[ok] = same_bytes(data, begin[left[ok]], begin[head[ok]], size[left[ok]])
        out[left[ok]] = classes + group[ok]
        classes += first.size
        left = left[~ok]
    return out


def row_numbers(texts: pa.Table) -> np.ndarray:
    """The number of each row among the different texts of its doc_id (in the order of their bytes); nearly always 0."""
    ids = np.asarray(texts["doc_id"], dtype=np.int64)
    out = np.zeros(ids.size, np.int64)
    order = np.argsort(ids, kind="stable")
    again = np.flatnonzero(ids[order][1:] == ids[order][:-1])
    for d in np.unique(ids[order][again]):
        rows = np.flatnonzero(ids == d)
        own = [texts["text"][int(k)].as_py() or "" for k in rows]
        number = {t: k for k, t in enumerate(sorted(set(own), key=str.encode))}
        out[rows] = [number[t] for t in own]
    return out


def _contexts(n_buckets: int):
    """Step 2, per shard: requests (kind 0) with contexts, and spans that are decided already (kind 1)."""

    def run(texts, replies):
        out = []
        if replies.num_rows and texts.num_rows:
            shard = int(replies["shard"][0].as_py())
            d, h = joined(replies["docs"].to_pylist(), np.int64), joined(replies["hashes"].to_pylist(), _U)
            known = np.unique(C.mix(h ^ (d.astype(_U) * _U(0x9E3779B97F4A7C15))))
            parts, doc, number, place, size, ctx, anchor = [], [], [], [], [], [], []
            texts = texts.append_column("number", pa.array(row_numbers(texts))).filter(pa.compute.is_in(texts["doc_id"], pa.array(np.unique(d))))
            for block in C.blocks(texts.combine_chunks().to_batches(), 1 << 20):
                data, off = C.text_bytes(block.column(block.schema.get_field_index("text")))
                at, hash_at, first, last = anchors(data, off)
                ids = np.asarray(block.column(block.schema.get_field_index("doc_id")), dtype=np.int64)
                row = np.searchsorted(off, at, "right") - 1
                key = C.mix(hash_at ^ (ids[row].astype(_U) * _U(0x9E3779B97F4A7C15)))
                where = np.minimum(np.searchsorted(known, key), known.size - 1)
                hit = np.flatnonzero(known[where] == key)
                if not hit.size:
                    continue
                a, n = first[hit], last[hit] - first[hit] + LENGTH
                parts.append((data, a, n))
                ctx.append(C.mix(C.span_hashes(data, a, a + n) + n.astype(_U)))
                anchor.append(hash_at[hit])
                doc.append(ids[row[hit]])
                number.append(np.asarray(block.column(block.schema.get_field_index("number")), dtype=np.int64)[row[hit]])
                place.append(a - off[row[hit]])
                size.append(n)
            if parts:
                doc, number, place, size, ctx, anchor = map(np.concatenate, (doc, number, place, size, ctx, anchor))
                blob = np.concatenate([x[ragged(a, n)] for x, a, n in parts])
                begin = np.cumsum(size) - size
                group = equal_contexts(blob, begin, size, ctx)
                least = np.full(group.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, group, doc)
                asks = doc == least[group]
                late = np.flatnonzero(~asks)
                if late.size:
                    out.append((shard % n_buckets, 1, shard, pack(doc[late]), pack(number[late]), pack(place[late]), pack(place[late] + size[late]), b""))
                bucket = np.minimum((anchor >> _U(32)) * _U(n_buckets) >> _U(32), _U(n_buckets - 1)).astype(np.int64)
                pick = np.flatnonzero(asks)
                pick = pick[np.argsort(bucket[pick], kind="stable")]
                cut = np.searchsorted(bucket[pick], np.arange(n_buckets + 1))
                press = zstandard.ZstdCompressor(level=1)
                for k in np.flatnonzero(np.diff(cut)):
                    own = pick[cut[k] : cut[k + 1]]
                    text = blob[ragged(begin[own], size[own])]
                    out.append((int(k), 0, shard, pack(doc[own]), pack(number[own]), pack(place[own]), pack(size[own].astype(np.int16)), press.compress(text.tobytes())))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64()), *[pa.array([x[k] for x in out], pa.binary()) for k in (3, 4, 5, 6, 7)]], ["bucket", "kind", "shard", "docs", "numbers", "begins", "ends", "blob"])

    return run


class BlindTrie:
    """Orders strings of one length: a node keeps the place of the first difference and one branch for each byte there; an
    insertion walks down by these bytes alone, compares with the leaf it meets, and ends there if it is equal, else
    branches at the first difference. So a leaf holds all strings that are equal."""

    def __init__(self, strings: list[bytes]):
        self.root = None  # a leaf is (string, numbers), a node is [depth, {byte: child}, some leaf below]
        for k, s in enumerate(strings):
            self.insert(k, s)

    def insert(self, new: int, s: bytes) -> None:
        node = self.root
        if node is None:
            self.root = (s, [new])
            return
        while node.__class__ is list:
            node = node[1].get(s[node[0]]) or node[2]
        t = node[0]
        if s == t:
            node[1].append(new)
            return
        depth = len(s) - ((int.from_bytes(s, "big") ^ int.from_bytes(t, "big")).bit_length() + 7) // 8
        leaf, parent, node = (s, [new]), None, self.root
        while node.__class__ is list and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if node.__class__ is list and node[0] == depth:
            node[1][s[depth]] = leaf
            return
        branch = [depth, {t[depth]: node, s[depth]: leaf}, leaf]
        if parent is None:
            self.root = branch
        else:
            parent[1][s[parent[0]]] = branch

    def leaves(self) -> list[list[int]]:
        """The numbers of the strings, equal ones together, in the strings' order."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if node.__class__ is list:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node[1])
        return out


def deep_shallow(data: np.ndarray, source: np.ndarray, width: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, class) of the strings data[s:s+width]: the sorted order, and for each place in it the number of its class
    of equal strings. Equal strings stay in input order."""
    n = source.size
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)

    def digit(level: int, which: np.ndarray) -> np.ndarray:
        """The 8 bytes at 8 * level of some strings as a number that sorts like them."""
        d = words[source[which] + 8 * level].view(">u8").reshape(-1).astype(_U)
        beyond = 8 * (level + 1) - width
        return d >> _U(8 * beyond) if beyond > 0 else d

    d = digit(0, np.arange(n))
    order = np.argsort(d, kind="stable")
    new = np.ones(n, bool)  # by place: whether a new group begins
    d = d[order]
    new[1:] = d[1:] != d[:-1]
    open_ = group = None

    def still_open():
        g = np.cumsum(new) - 1
        at = np.flatnonzero(np.bincount(g)[g] > 1)
        return at, g[at]

    for level in range(1, max(1, shallow // 8)):
        open_, group = still_open()
        if not open_.size:
            break
        sub = order[open_]
        d = digit(level, sub)
        again = np.lexsort((d, group))
        order[open_] = sub[again]
        d = d[again]
        new[open_[1:][(group[1:] == group[:-1]) & (d[1:] != d[:-1])]] = True
    open_, group = still_open()
    if open_.size:  # groups with a longer common prefix, each at consecutive places: a blind trie for each
        raw, at = data.tobytes(), source[order[open_]]
        bounds = [*np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))).tolist(), group.size]
        moved = order[open_]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            rest = [raw[p + shallow : p + width] for p in at[lo:hi].tolist()]
            if hi - lo == 2:  # a trie of two strings is one comparison
                a, b = rest
                if a != b:
                    new[open_[lo + 1]] = True
                    if b < a:
                        moved[lo], moved[lo + 1] = moved[lo + 1], moved[lo]
                continue
            leaves = BlindTrie(rest).leaves()
            if len(leaves) > 1:
                moved[lo:hi] = moved[lo:hi][[k for leaf in leaves for k in leaf]]
                new[open_[lo] + np.cumsum([len(leaf) for leaf in leaves[:-1]])] = True
        order[open_] = moved
    return order, np.cumsum(new) - 1


def _removals(n_shards: int):
    """Step 3, per bucket of contexts: (shard, docs, numbers, begins, ends) of the removal spans."""

    def run(table):
        kind, out = np.asarray(table["kind"]), []
        cols = {c: table[c].to_pylist() for c in ("shard", "docs", "numbers", "begins", "ends", "blob")}
        for k in np.flatnonzero(kind == 1):
            out.append(tuple(cols[c][k] for c in ("shard", "docs", "numbers", "begins", "ends")))
        own = np.flatnonzero(kind == 0)
        if own.size:
            doc, number, place = (joined([cols[c][k] for k in own], np.int64) for c in ("docs", "numbers", "begins"))
            size = joined([cols["ends"][k] for k in own], np.int16).astype(np.int64)
            data = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(cols["blob"][k]), np.uint8) for k in own])
            begin = np.cumsum(size) - size
            h = C.mix(C.span_hashes(data, begin, begin + size) + size.astype(_U))
            group = equal_contexts(data, begin, size, h)
            least = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, doc)
            late = doc > least[group]
            spans = [(doc[late], number[late], place[late], place[late] + size[late])]
            # one of each context goes into the suffix array; the same document may hold it again
            keep = np.flatnonzero(~late)
            n = size[keep] - LENGTH + 1
            entry = np.repeat(np.arange(keep.size), n)
            inner = ragged(np.zeros(keep.size, np.int64), n)
            order, cls = deep_shallow(data, begin[keep][entry] + inner)
            d = doc[keep][entry][order]
            small = np.full(cls[-1] + 1 if cls.size else 0, np.iinfo(np.int64).max)
            np.minimum.at(small, cls, d)
            gone = np.zeros(entry.size, bool)
            gone[order] = d > small[cls]
            hit = np.flatnonzero(gone)
            if hit.size:
                e, j = entry[hit], inner[hit]
                head = np.ones(hit.size, bool)
                head[1:] = (e[1:] != e[:-1]) | (j[1:] != j[:-1] + 1)
                a = np.flatnonzero(head)
                b = np.append(a[1:], hit.size) - 1
                spans.append((doc[keep][e[a]], number[keep][e[a]], place[keep][e[a]] + j[a], place[keep][e[a]] + j[b] + LENGTH))
            d, m, a, b = (np.concatenate([s[k] for s in spans]) for k in range(4))
            if d.size:
                shard = d % n_shards
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(n_shards + 1))
                for k in np.flatnonzero(np.diff(cut)):
                    i = order[cut[k] : cut[k + 1]]
                    out.append((int(k), pack(d[i]), pack(m[i]), pack(a[i]), pack(b[i])))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), *[pa.array([x[k] for x in out], pa.binary()) for k in (1, 2, 3, 4)]], ["shard", "docs", "numbers", "begins", "ends"])

    return run


def _cut(texts, replies):
    """Step 4, per shard: (doc_id, n_bytes, spans, kept) of its documents."""
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    if replies.num_rows:
        d, m, a, b = (joined(replies[c].to_pylist(), np.int64) for c in ("docs", "numbers", "begins", "ends"))
        order = np.lexsort((a, m, d))
        d, m, a, b = d[order], m[order], a[order], b[order]
        wide = int(b.max()) + 2
        row = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (m[1:] != m[:-1]))))
        reach = np.maximum.accumulate(b + row * wide)
        head = np.ones(d.size, bool)
        head[1:] = (a[1:] + row[1:] * wide) > reach[:-1]
        start = np.flatnonzero(head)
        stop = np.append(start[1:], d.size) - 1
        for x, k, s, e in zip(d[start].tolist(), m[start].tolist(), a[start].tolist(), (reach[stop] - row[stop] * wide).tolist(), strict=True):
            spans.setdefault((x, k), []).append((s, e))
    ids, raw, found, kept = texts["doc_id"].to_pylist(), [], [], []
    for i, k, t in zip(ids, row_numbers(texts).tolist(), texts["text"].to_pylist(), strict=True):
        t = (t or "").encode()
        own = spans.get((i, k), [])
        at, parts = 0, []
        for s, e in own:
            parts.append(t[at:s])
            at = e
        raw.append(len(t))
        found.append([{"begin": s, "end": e} for s, e in own])
        kept.append(b"".join([*parts, t[at:]]))
    return pa.table([texts["doc_id"], pa.array(raw, pa.int64()), pa.array(found, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def prime(n: int) -> int:
    n = max(3, n | 1)
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the removed byte ranges and the remaining bytes of every document."""
    import pyarrow.compute  # noqa: F401

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = docs.where("doc_id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = prime(max(docs.sparkSession.sparkContext.defaultParallelism * 2, int(total / SHARD_BYTES / max(1.0, total / ROOT_BYTES) ** 0.5)))
    n_buckets = 2 * n_shards
    ask, answer = _ask(n_buckets, n_shards)
    packed = "docs binary, hashes binary"
    asked = known.mapInArrow(ask, f"bucket long, kind int, shard long, {packed}")
    repeated = asked.groupBy("bucket").applyInArrow(answer, f"shard long, {packed}")
    texts = known.select(F.pmod("doc_id", F.lit(n_shards)).alias("shard"), "doc_id", "text")
    spans = "docs binary, numbers binary, begins binary, ends binary"
    contexts = texts.groupBy("shard").cogroup(repeated.groupBy("shard")).applyInArrow(_contexts(n_buckets), f"bucket long, kind int, shard long, {spans}, blob binary")
    removed = contexts.groupBy("bucket").applyInArrow(_removals(n_shards), f"shard long, {spans}")
    out = texts.groupBy("shard").cogroup(removed.groupBy("shard")).applyInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
    rest = docs.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<begin:long,end:long>>").alias("spans"), F.col("text").cast("binary").alias("kept"))
    return out.unionByName(rest)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(C.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: dict, length: int = LENGTH) -> dict:
    """Reference by plain loops: doc_id -> (n_bytes, n_removed, n_spans, kept digest). For tests."""
    import hashlib

    raw = {d: (t or "").encode() for d, t in texts.items()}
    least: dict[bytes, int] = {}
    for d in sorted(raw):
        for i in range(len(raw[d]) - length + 1):
            least.setdefault(raw[d][i : i + length], d)
    out = {}
    for d, t in raw.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        n = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(t), sum(gone), n, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out
