"""SentencePiece encoding and decoding with byte offsets, from the model file.

The model file (protocol buffer) is parsed here. Normalisation walks the compiled character map (a double-array trie
over UTF-8 and a table of replacements): at each place the longest matching key is replaced, else one character is
copied, and every normalised byte records the source byte range that it came from. Spaces become U+2581 and one is put
in front. The byte-pair encoder then joins the neighbouring symbols whose joined piece scores best (ties: leftmost)
until none is left; characters without a piece fall back to byte pieces. Each piece is projected over the alignment to
the original bytes that it covers. Decoding starts from the ids alone.

No piece holds U+2581 after another character (checked when the model is read), so text is cut before each run of
spaces and the parts are encoded on their own, which lets equal parts share one result; likewise the ids of a part are
decoded once (a part ends with a whole character, so no run of byte pieces goes on in the next).

Defined cases: null and empty text give no ids, no spans and decode to the empty text; texts of any length are encoded
whole (a heap keeps long parts at n log n); pieces of one score (ties) join leftmost first; repeated rows are independent; nulls
in other columns pass as they are; an empty table gives an empty result. Only doc_id and text are read (`tokenize` also passes lang and
source), so further columns may carry any name. There is no shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common as C

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_PART = re.compile(f"[ {SPACE}]+[^ {SPACE}\n]*|[^ {SPACE}\n]+|\n")
_LONG = 64  # symbols from which the heap is used
_CACHE = 100_000
_NEVER = 1 << 60
_MISSING = (1 << 20) - 1  # a character without a piece; no pair holds it


def default_model() -> str:
    """The public 32k byte-pair model; QUARRY_TOKENIZERS names another folder of tokenizer files."""
    if folder := os.environ.get("QUARRY_TOKENIZERS"):
        return os.path.join(folder, "piece_bpe_32k.model")
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class CharacterMap:
    """A compiled character map: longest-prefix search in its double array. Empty bytes: the identity."""

    def __init__(self, blob: bytes = b""):
        self.units: tuple[int, ...] = ()
        self.out = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.out = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that text has at `at`."""
        units, found = self.units, None
        if not units:
            return None
        node, unit = 0, units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                value = units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.out[value : self.out.index(b"\0", value)])
        return found

    def normalize(self, text: bytes, space: bytes = SPACE.encode()) -> tuple[bytes, list[int], list[int]]:
        """The normalised bytes and, for each, the source range [begin, end) that it comes from."""
        out, begin, end, at = bytearray(), [], [], 0
        while at < len(text):
            got = self.longest(text, at)
            if got is None:
                n = 1 if text[at] < 0x80 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
                got = (n, text[at : at + n])
            n, piece = got
            piece = piece.replace(b" ", space)
            out += piece
            begin += [at] * len(piece)
            end += [at + n] * len(piece)
            at += n
        return bytes(out), begin, end


    def symbols(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised characters and, for each, the source bytes that it adds to those before it (None: one each)."""
        if not self.units:  # no key: every character is copied
            return text.replace(" ", SPACE), None if text.isascii() else [len(c.encode()) for c in text]
        norm, _, end = self.normalize(text.encode())
        out, source, last, k = norm.decode("utf-8", "replace"), [], 0, 0
        for c in out:
            k += len(c.encode())
            source.append(max(0, end[k - 1] - last))
            last = max(last, end[k - 1])
        return out, source


class Kept(dict):
    """Results of a function by its argument; age() drops what was not used for a while once there are _CACHE of them."""

    def __init__(self, of):
        super().__init__()
        self.of, self.older = of, {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.of(key)
        self[key] = out
        return out

    def age(self) -> None:
        if len(self) >= _CACHE:
            self.older = dict(self)
            self.clear()


class Model:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        charsmap, self.dummy_prefix, self.strip, self.escape, self.suffix, self.kind = b"", True, True, True, False, 1
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(fields(value))
                self.kind, self.suffix = spec.get(3, 1), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(fields(value))
                charsmap, self.dummy_prefix, self.strip, self.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.map = CharacterMap(charsmap)
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        if self.kind != 2 or self.suffix or self.strip or not self.escape or any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in self.ids):
            raise ValueError("only byte-pair models that keep white space and never join across words are supported")
        rank = {s: k for k, s in enumerate(sorted(set(self.scores), reverse=True))}
        self.ranked: dict[int, int] = {}  # a pair of pieces (left << 20 | right) -> (rank << 20 | joined piece)
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.ranked[(a << 20) | b] = (rank[self.scores[i]] << 20) | i
        alike: dict[int, set[int]] = {}  # pieces of one score need the heap
        for m in self.ranked.values():
            alike.setdefault(m >> 20, set()).add(m & 0xFFFFF)
        self.tied = {r for r, js in alike.items() if len(js) > 1}
        self.plain = not charsmap
        self.pair_keys, self.pair_values = (np.array(x, np.int64) for x in zip(*sorted(self.ranked.items()), strict=True))
        self.is_tied = np.array([r in self.tied for r in range(len(rank) + 1)])
        self.by_code = np.full(0x110000, _MISSING, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.by_code[ord(p)] = i
        self.names = [str(i) for i in range(len(self.pieces))]
        self.shown = {str(i): p.replace(SPACE, " ") for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER, UNUSED)}
        self.cache, self.decoded = Kept(self.part), Kept(self.decode_part)

    def join(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """(pieces, symbols that each covers) after all joins; _MISSING never joins. Takes over the list."""
        if len(ids) > _LONG:
            return self._join_long(ids)
        get, tied, given = self.ranked.get, self.tied, ids[:]
        size = [1] * len(ids)
        best = [get((a << 20) | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while best:
            m = min(best)
            if m == _NEVER:
                break
            if m >> 20 in tied:
                return self._join_long(given)
            i = best.index(m)
            ids[i] = now = m & 0xFFFFF
            size[i] += size.pop(i + 1)
            del ids[i + 1], best[i]
            if i:
                best[i - 1] = get((ids[i - 1] << 20) | now, _NEVER)
            if i < len(best):
                best[i] = get((now << 20) | ids[i + 1], _NEVER)
        return ids, size

    def _join_long(self, ids: list[int]) -> tuple[list[int], list[int]]:
        n = len(ids)

        def joins(a: int, b: int) -> tuple[int, int] | None:
            m = self.ranked.get((a << 20) | b)
            return None if m is None else (m >> 20, m & 0xFFFFF)

        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        heap = [(*got, i, ids[i], ids[i + 1]) for i in range(n - 1) if (got := joins(ids[i], ids[i + 1]))]
        heap = [(r, i, a, b, j) for r, j, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, j = heapq.heappop(heap)
            k = after[i]
            if size[i] == 0 or ids[i] != a or k >= n or ids[k] != b:
                continue
            ids[i] = j
            size[i] += size[k]
            size[k] = 0
            ids[k] = -2
            after[i] = after[k]
            if after[k] < n:
                before[after[k]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (got := joins(ids[x], ids[y])):
                    heapq.heappush(heap, (got[0], x, ids[x], ids[y], got[1]))
        left = [i for i in range(n) if size[i]]
        return [ids[i] for i in left], [size[i] for i in left]

    def part(self, text: str) -> tuple[str, int, bytes]:
        """(ids joined by commas, their number, source bytes of each piece as 4-byte numbers) of a part."""
        symbols, source = self.map.symbols(text)
        get = self.ids.get
        ids, sizes = self.join([get(c, _MISSING) for c in symbols])
        if source is None and _MISSING not in ids:  # every symbol covers one byte
            return ",".join(map(self.names.__getitem__, ids)), len(ids), array("I", sizes).tobytes()
        source = source or [1] * len(symbols)
        out, lens, at = [], [], 0
        for i, n in zip(ids, sizes, strict=True):
            span = source[at] if n == 1 else sum(source[at : at + n])
            if i != _MISSING:
                out.append(i)
                lens.append(span)
            elif self.bytes:
                b = symbols[at].encode()
                out += [self.bytes[x] for x in b]
                lens += [1] * len(b) if span == len(b) else [span] + [0] * (len(b) - 1)
            else:
                out.append(self.unknown)
                lens.append(span)
            at += n
        return ",".join(map(self.names.__getitem__, out)), len(out), array("I", lens).tobytes()

    def part_many(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """The same of many parts side by side: in each round every part makes its best join, until none has one.

        Only for a map without keys; parts that need the heap or byte pieces are left to `part`."""
        code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        count = np.array([len(t) for t in texts], np.int64)
        part = np.repeat(np.arange(len(texts)), count)
        size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)  # source bytes
        ids = self.by_code[np.where(code == 32, ord(SPACE), code)].astype(np.int64)
        alone = (count > _LONG) | (np.bincount(part[ids == _MISSING], minlength=count.size) > 0)
        keep = ~alone[part]
        ids, size, part = ids[keep], size[keep], part[keep]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        best = np.full(ids.size, _NEVER)
        same = np.flatnonzero(part[1:] == part[:-1])
        best[same] = self._ranked((ids[same] << 20) | ids[same + 1])
        while ids.size:
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            least = np.minimum.reduceat(best, first)
            number = np.cumsum(np.bincount(first, minlength=ids.size)) - 1
            tied = (least != _NEVER) & self.is_tied[np.minimum(least >> 20, self.is_tied.size - 1)]
            alone[part[first[tied]]] = True
            over = (least == _NEVER) & ~tied
            if over.any() or tied.any():
                stop = over[number]
                done.append((part[stop], ids[stop], size[stop]))
                stay = ~(stop | tied[number])
                ids, size, part, best = ids[stay], size[stay], part[stay], best[stay]
                if not ids.size:
                    break
                go = ~(over | tied)
                least, number = least[go], (np.cumsum(go) - 1)[number[stay]]
            at = np.flatnonzero(best == least[number])
            at = at[np.concatenate(([True], number[at][1:] != number[at][:-1]))]  # the leftmost of each part
            ids[at] = best[at] & 0xFFFFF
            size[at] += size[at + 1]
            best[at] = best[at + 1]
            stay = np.ones(ids.size, bool)
            stay[at + 1] = False
            at -= np.arange(at.size)  # as many symbols have gone before each
            ids, size, part, best = ids[stay], size[stay], part[stay], best[stay]
            left = at[(at > 0) & (part[np.maximum(at - 1, 0)] == part[at])] - 1
            right = at[(at + 1 < ids.size) & (part[np.minimum(at + 1, ids.size - 1)] == part[at])]
            new = np.concatenate((left, right))
            best[right] = best[left] = _NEVER
            best[new] = self._ranked((ids[new] << 20) | ids[new + 1])
        out: list = [None] * len(texts)
        if sum(d[0].size for d in done):
            part, ids, size = (np.concatenate([d[k] for d in done]) for k in range(3))
            begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist()
            names, raw = [self.names[i] for i in ids.tolist()], size.astype("<u4").tobytes()
            for a, b, k in zip(begin, [*begin[1:], part.size], part[begin].tolist(), strict=True):
                out[k] = ",".join(names[a:b]), b - a, raw[4 * a : 4 * b]
        for k in np.flatnonzero(alone).tolist():
            out[k] = self.part(texts[k])
        return out

    def _ranked(self, pairs: np.ndarray) -> np.ndarray:
        """(rank << 20 | joined piece) of pairs of pieces, _NEVER where they don't join."""
        at = np.minimum(np.searchsorted(self.pair_keys, pairs), self.pair_keys.size - 1)
        return np.where(self.pair_keys[at] == pairs, self.pair_values[at], _NEVER)

    def parts_of(self, texts: list[str | None]) -> list[list[tuple[str, int, bytes]]]:
        """The parts of each text, encoded; what has not been met is encoded at once."""
        if not self.plain:
            return [[self.cache[self.whole(t)]] if t else [] for t in texts]
        cut = [_PART.findall(" " + t if self.dummy_prefix else t) if t else [] for t in texts]
        self.cache.age()
        cache, older = self.cache, self.cache.older
        new = []
        for p in set().union(*cut).difference(cache):
            if p in older:
                cache[p] = older[p]
            else:
                new.append(p)
        for i in range(0, len(new), 10_000):
            cache.update(zip(new[i : i + 10_000], self.part_many(new[i : i + 10_000]), strict=True))
        return [[cache[p] for p in own] for own in cut]

    def parts(self, text: str) -> list[tuple[str, int, bytes]]:
        return self.parts_of([text])[0]

    def cover(self, parts: list[tuple[str, int, bytes]]) -> np.ndarray:
        """How many source bytes each piece covers. The space put in front covers none."""
        out = bytearray().join([p[2] for p in parts])
        if self.dummy_prefix and out:
            at = 0
            while not any(out[at : at + 4]):
                at += 4
            out[at : at + 4] = (int.from_bytes(out[at : at + 4], "little") - 1).to_bytes(4, "little")
        return np.frombuffer(out, "<u4")

    def decode_part(self, ids: str) -> str:
        """decode() of ids joined by commas inside a text; pieces that are plain text are looked up."""
        each = ids.split(",")
        try:
            return "".join(map(self.shown.__getitem__, each))
        except KeyError:
            return self.decode([int(i) for i in each], first=False)

    def decode_parts(self, ids: list[str]) -> str:
        """decode() of the ids of all parts; those of a part are decoded once."""
        if not ids:
            return ""
        self.decoded.age()
        text = "".join(map(self.decoded.__getitem__, ids))
        first = int(ids[0].split(",", 1)[0])
        return text[1:] if self.dummy_prefix and self.kinds[first] not in (BYTE, UNKNOWN, CONTROL) and self.pieces[first].startswith(SPACE) else text

    def encode(self, text: str) -> tuple[str, int, str, np.ndarray]:
        """(ids joined by commas, their number, the text decoded from them, source bytes of each piece)."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[tuple[str, int, str, np.ndarray]]:
        out = []
        for parts in self.parts_of(texts):
            ids = [p[0] for p in parts]
            out.append((",".join(ids), sum([p[1] for p in parts]), self.decode_parts(ids), self.cover(parts)))
        return out

    def whole(self, text: str) -> str:
        return (" " if self.dummy_prefix else "") + text

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of any ids: byte pieces are put together (an ill-formed byte becomes U+FFFD), control pieces are silent.

        first: whether the ids begin a text, whose first space was put in front."""
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(ill_formed(bytes(run)))
                run.clear()
            if i is not None and self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif i is not None and self.kinds[i] != CONTROL:
                piece = self.pieces[i]
                if first and self.dummy_prefix and not out and piece.startswith(SPACE):
                    piece = piece[1:]
                    out.append("")
                out.append(piece.replace(SPACE, " "))
        return "".join(out)


def ill_formed(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        n = 1 if data[at] < 0x80 else 2 if 0xC2 <= data[at] < 0xE0 else 3 if 0xE0 <= data[at] < 0xF0 else 4 if 0xF0 <= data[at] < 0xF5 else 1
        try:
            out.append(data[at : at + n].decode())
            at += n
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, spans, decoded): spans are the [begin, end) source bytes of every piece."""
    path = path or default_model()
    pair = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(batches):
        m = model(path)
        for block in C.blocks(batches):
            ids, spans, shown = [], [], []
            for joined, n, decoded, cover in m.encode_many(block.column(1).to_pylist()):
                ends, cover = np.cumsum(cover, dtype=np.int64), cover.astype(np.int64)
                ids.append([int(x) for x in joined.split(",")] if n else [])
                spans.append([{"begin": a, "end": b} for a, b in zip((ends - cover).tolist(), ends.tolist(), strict=True)])
                shown.append(decoded)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(spans, pa.list_(pair)), pa.array(shown, pa.string())], ["doc_id", "ids", "spans", "decoded"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, spans array<struct<begin:long,end:long>>, decoded string")


#: The spans' digest is over the lengths of all pieces as 4-byte numbers, lowest byte first; each begins where the one before ends.
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long, spans_sha256 string"


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the ids, of the text decoded from them and of the spans, and the source bytes that the spans cover (all of
    the text's)."""
    path = path or default_model()

    def run(batches):
        m = model(path)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for block in C.blocks(batches):
            rows = []
            for joined, n, decoded, cover in m.encode_many(block.column(1).to_pylist()):
                rows.append((n, sha(joined.encode()), sha(decoded.encode()), int(cover.sum(dtype=np.int64)), sha(cover)))
            n, ids, decoded, covered, spans = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([block.column(0), C.as_long(n), pa.array(ids), pa.array(decoded), C.as_long(covered), pa.array(spans)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes", "spans_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST)


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and whether decoding gives the text back, for training."""
    path = path or default_model()

    def run(batches):
        m = model(path)
        for block in C.blocks(batches):
            texts = block.column(3).to_pylist()
            parts = m.parts_of(texts)
            rows = [[p[0] for p in own] for own in parts]
            n = np.array([sum([p[1] for p in own]) for own in parts], np.int64)
            flat = ",".join([i for r in rows for i in r])
            ids = np.array(flat.split(","), dtype=np.int32) if flat else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(ids))
            same = [m.decode_parts(r) == (t or "") for r, t in zip(rows, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), block.column(2), lists, pa.array(n), pa.array(same)], ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), "text").mapInArrow(run, "doc_id long, lang string, source string, ids array<int>, n_tokens long, round_trip boolean")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(C.table(spark, sf_dir, "documents"))
