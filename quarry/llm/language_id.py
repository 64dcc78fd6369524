"""Language identification by interpolated Kneser-Ney character models, one per language.

Training counts the character n-grams of order ORDER of all training texts (folded to lower case, every run of
non-letters one space), pre-aggregated per task and summed by (language, n-gram). From these counts the lower orders'
continuation counts follow, then back-off weights and log-probabilities, all by aggregations and joins over every n-gram.
A model is kept as sorted arrays of n-gram hashes with one column of log-probabilities per language; a text is looked up
in them from the longest order down, unseen n-grams through the context's back-off weight.
The language of the lowest cross-entropy per character wins. The score is the probability that the winner is right, by a
logistic calibration on training rows that the models have not counted: those whose id's hash falls below a share, at most
CALIBRATION_SHARE of the rows and about CALIBRATION_DOCS of them. `rejected` marks scores under REJECT.

The counts cover all other training rows and the model keeps every n-gram. It grows with the corpus, so it is neither collected
nor broadcast: tasks write their ranges of the sorted arrays into files under spark.checkpoint.dir (a folder that driver
and executors mount), and scoring maps these files into memory. A task that runs again writes the same bytes to the same places.

Defined cases: null text or text without a letter is `und` with score 0; null languages, texts and ids in training are left out;
repeated rows count, and are scored, each on their own; ties go to the language first in order; with no training row
everything is `und`; an empty table gives an empty result; texts of any length are counted and scored whole. Only doc_id and text
are read when scoring (and lang when training), so further columns may carry any name.
"""

from __future__ import annotations

import os
import unicodedata
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common as C

ORDER = 4
DISCOUNT = 0.75
UNIFORM = float(np.log(1 / 1000))
SHARD_BITS = 6  # the leading bits of a hash name the range of the sorted arrays that one task writes
CALIBRATION_DOCS, CALIBRATION_SHARE = 2_000, 0.1
REJECT = 0.5
_U = np.uint64
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _LETTERS[0]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded code points of all texts, first symbol of each and the end, letters in each).

    Every text is put between spaces; ORDER - 1 of them stand before it."""
    pad = " " * (ORDER - 1)
    folded = [pad + (t or "").lower() + " " for t in texts]
    code = np.frombuffer("".join(folded).encode("utf-32-le", "replace"), np.uint32).copy()
    off = np.concatenate(([0], np.cumsum([len(t) for t in folded])))
    letter = letters()[code]
    code[~letter] = 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of spaces the first stays
    for k in range(ORDER - 1):
        keep[off[:-1] + k] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    n_letters = np.concatenate(([0], np.cumsum(letter)))
    return code[keep], total[off], n_letters[off[1:]] - n_letters[off[:-1]]


def gram_hashes(code: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols that end at each place (the first n - 1 places have none)."""
    return C.ngram_hashes(C.mix(code.astype(_U) + _U(1)), n)


def count(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each n-gram of ORDER characters occurs in the texts of each language."""

    def run(batches):
        have: dict[str, dict[str, int]] = {}
        for block in C.blocks(batches):
            langs = np.array(block.column(1).to_pylist(), object)
            texts = block.column(0).to_pylist()
            for lang in sorted(set(langs)):
                code, first, _ = symbols([t for t, x in zip(texts, langs, strict=True) if x == lang])
                ends = np.ones(code.size, bool)
                for k in range(ORDER - 1):
                    ends[first[:-1] + k] = False
                at = np.flatnonzero(ends)
                _, where, n = np.unique(gram_hashes(code, ORDER)[at - (ORDER - 1)], return_index=True, return_counts=True)
                at = at[where]
                chars = np.stack([code[at - k] for k in reversed(range(ORDER))], axis=1).astype("<u4")
                grams = chars.tobytes().decode("utf-32-le")
                own = have.setdefault(lang, {})
                for k, m in enumerate(n.tolist()):
                    g = grams[k * ORDER : k * ORDER + ORDER]
                    own[g] = own.get(g, 0) + m
            if sum(map(len, have.values())) > 1_000_000:
                yield from flush(have)
                have = {}
        yield from flush(have)

    def flush(have):
        for lang, own in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def text_hash(grams: list[str]) -> np.ndarray:
    if not grams:
        return np.zeros(0, _U)
    n = len(grams[0])
    code = np.frombuffer("".join(grams).encode("utf-32-le", "replace"), np.uint32)
    return gram_hashes(code, n)[::n] if n > 1 else gram_hashes(code, 1)


class Models:
    """Log-probabilities and back-off weights per order, for all languages side by side."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        self.uniform = UNIFORM
        self.hash, self.logp, self.context, self.backoff = {}, {}, {}, {}
        per = [self._kneser_ney(counts[counts["lang"] == lang]) for lang in self.langs]
        for n in range(1, ORDER + 1):
            grams = sorted(set().union(*[set(p[0][n]) for p in per]))
            contexts = sorted(set().union(*[set(p[1][n]) for p in per])) if n > 1 else []
            h, c = text_hash(grams), text_hash(contexts)
            order, corder = np.argsort(h), np.argsort(c)
            lp = np.stack([self._full(p, n, grams) for p in per], axis=1) if per else np.zeros((len(grams), 0))
            self.hash[n], self.logp[n] = h[order], lp[order].astype(np.float32)
            self.context[n] = c[corder]
            bo = np.stack([np.array([p[1][n].get(g, 0.0) for g in contexts]) for p in per], axis=1) if per and contexts else np.zeros((len(contexts), len(per)))
            self.backoff[n] = bo[corder].astype(np.float32)

    def _kneser_ney(self, own: pd.DataFrame):
        """({order: {n-gram: log p}}, {order: {context: log back-off}}), interpolated, lowest order first."""
        level = dict(zip(own["gram"], own["n"], strict=True))
        tables = {ORDER: level}
        for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many ways an n-gram is preceded
            lower: dict[str, int] = {}
            for g in tables[n + 1]:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            tables[n] = lower
        logp, backoff = {}, {}
        for n in range(1, ORDER + 1):
            total: dict[str, float] = {}
            kinds: dict[str, int] = {}
            for g, c in tables[n].items():
                total[g[:-1]] = total.get(g[:-1], 0) + c
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            backoff[n] = {h: float(np.log(DISCOUNT * kinds[h] / total[h])) for h in total}
            logp[n] = {}
            for g, c in tables[n].items():
                below = logp[n - 1].get(g[1:], self.uniform) if n > 1 else self.uniform
                logp[n][g] = float(np.log(max(c - DISCOUNT, 0) / total[g[:-1]] + np.exp(backoff[n][g[:-1]] + below)))
        return logp, backoff

    def _full(self, p, n: int, grams: list[str]) -> np.ndarray:
        """Log-probability of each n-gram under one language, with back-off where the language has not seen it."""
        logp, backoff = p

        def of(g: str, k: int) -> float:
            if k == 0:
                return self.uniform
            got = logp[k].get(g)
            return got if got is not None else backoff[k].get(g[:-1], 0.0) + of(g[1:], k - 1)

        return np.array([of(g, n) for g in grams])

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character and language, letters) of each text."""
        code, first, n_letters = symbols(texts)
        wide = len(self.langs)
        skip = np.zeros(code.size, bool)
        for k in range(ORDER - 1):
            skip[first[:-1] + k] = True
        at = np.flatnonzero(~skip)
        total = np.zeros((at.size, wide), np.float32)
        left = np.arange(at.size)
        for n in range(ORDER, 0, -1):
            if not left.size:
                break
            h = gram_hashes(code, n)[at[left] - (n - 1)]
            where = np.minimum(np.searchsorted(self.hash[n], h), max(0, self.hash[n].size - 1))
            hit = self.hash[n][where] == h if self.hash[n].size else np.zeros(h.size, bool)
            total[left[hit]] += self.logp[n][where[hit]]
            left = left[~hit]
            if n > 1 and left.size and self.context[n].size:
                c = gram_hashes(code, n - 1)[at[left] - (n - 1)]
                where = np.minimum(np.searchsorted(self.context[n], c), self.context[n].size - 1)
                hit = self.context[n][where] == c
                total[left[hit]] += self.backoff[n][where[hit]]
        total[left] += self.uniform  # a character that no language has
        sizes = np.diff(first) - (ORDER - 1)
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        sums = np.zeros((len(texts), wide))
        some = sizes > 0
        if some.any():
            sums[some] = np.add.reduceat(total.astype(np.float64), starts[some], axis=0)
        return -sums / np.maximum(1, sizes)[:, None], n_letters


class StoredModels(Models):
    """The same arrays in files of a shared folder, mapped into memory where they are first used."""

    def __init__(self, langs: list[str], folder: str, sizes: dict[int, int]):
        self.langs, self.folder, self.sizes, self.uniform = langs, folder, sizes, UNIFORM

    def __getattr__(self, name):
        if name not in ("hash", "logp", "context", "backoff"):
            raise AttributeError(name)
        self.hash, self.logp = self._arrays(range(1, ORDER + 1), 0)
        self.context, self.backoff = self._arrays(range(2, ORDER + 1), ORDER)
        self.context[1], self.backoff[1] = np.zeros(0, _U), np.zeros((0, len(self.langs)), np.float32)
        return self.__dict__[name]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("hash", "logp", "context", "backoff")}

    def _arrays(self, orders, shift: int):
        wide, keys, values = len(self.langs), {}, {}
        for n in orders:
            size = self.sizes.get(n + shift, 0)
            keys[n] = np.asarray(np.memmap(f"{self.folder}/{n + shift}.hash", _U, "r", shape=(size,))) if size else np.zeros(0, _U)
            values[n] = np.asarray(np.memmap(f"{self.folder}/{n + shift}.values", np.float32, "r", shape=(size, wide))) if size else np.zeros((0, wide), np.float32)
        return keys, values


def kneser_ney(counts: DataFrame, langs: list[str]) -> DataFrame:
    """(part, key, v): log-probabilities of every n-gram (part = its order) and back-off weights of every context of order
    n (part = ORDER + n), one for each language; the recursions of Models by aggregations and joins."""
    every = range(len(langs))
    level = {ORDER: C.cut(counts.groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"c{i}") for i, lang in enumerate(langs)]))}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many ways an n-gram is preceded
        level[n] = C.cut(level[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(*[F.sum((F.col(f"c{i}") > 0).cast("long")).alias(f"c{i}") for i in every]))
    out, below = None, None
    for n in range(1, ORDER + 1):
        sums = [F.sum(f"c{i}").alias(f"t{i}") for i in every] + [F.sum((F.col(f"c{i}") > 0).cast("long")).alias(f"k{i}") for i in every]
        contexts = level[n].groupBy(F.substring("gram", 1, n - 1).alias("context")).agg(*sums)
        contexts = C.cut(contexts.select("context", *[F.col(f"t{i}") for i in every], *[F.when(F.col(f"t{i}") > 0, F.log(F.lit(DISCOUNT) * F.col(f"k{i}") / F.col(f"t{i}"))).otherwise(0.0).alias(f"b{i}") for i in every]))
        rows = level[n].withColumn("context", F.substring("gram", 1, n - 1)).join(contexts, "context")
        if below is None:
            rows = rows.select("*", *[F.lit(UNIFORM).alias(f"f{i}") for i in every])
        else:
            rows = rows.withColumn("suffix", F.substring("gram", 2, n - 1)).join(below, "suffix")
        seen = lambda i: F.log((F.col(f"c{i}") - DISCOUNT) / F.col(f"t{i}") + F.exp(F.col(f"b{i}") + F.col(f"f{i}")))
        full = C.cut(rows.select("gram", *[F.when(F.col(f"c{i}") > 0, seen(i)).otherwise(F.col(f"b{i}") + F.col(f"f{i}")).alias(f"f{i}") for i in every]))
        below = full.withColumnRenamed("gram", "suffix")
        parts = [full.select(F.lit(n).alias("part"), F.col("gram").alias("key"), F.array(*[F.col(f"f{i}").cast("float") for i in every]).alias("v"))]
        if n > 1:
            parts.append(contexts.select(F.lit(ORDER + n).alias("part"), F.col("context").alias("key"), F.array(*[F.col(f"b{i}").cast("float") for i in every]).alias("v")))
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out


def store(rows: DataFrame, langs: list[str]) -> StoredModels:
    """Writes (part, key, v) as arrays sorted by hash, range by range and each at its own place of the files."""
    where = urlparse(C.checkpoint_dir(rows.sparkSession))
    if where.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder for language models, not {where.scheme}:")
    folder, wide = f"{unquote(where.path)}/language_id-{uuid.uuid4().hex}", len(langs)

    def hashed(batches):
        for batch in batches:
            part = np.array(batch.column(0))
            keys, h = batch.column(1).to_pylist(), np.zeros(batch.num_rows, _U)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                h[at] = text_hash([keys[k] for k in at])
            shard = (h >> _U(64 - SHARD_BITS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard), pa.array((h ^ _U(1 << 63)).view(np.int64)), batch.column(2)], ["part", "shard", "h", "v"])

    table = C.cut(rows.mapInArrow(hashed, "part int, shard int, h long, v array<float>"))
    sizes, first = {}, {}
    for r in sorted(table.groupBy("part", "shard").count().collect()):
        first[r["part"], r["shard"]] = sizes.get(r["part"], 0)
        sizes[r["part"]] = sizes.get(r["part"], 0) + r["count"]
    os.makedirs(folder)
    for p, size in sizes.items():
        for name, width in (("hash", 8), ("values", 4 * wide)):
            with open(f"{folder}/{p}.{name}", "wb") as f:
                f.truncate(size * width)

    def write(batches):
        at = dict(first)
        for batch in batches:
            group = np.stack([np.array(batch.column(0)), np.array(batch.column(1))], axis=1)
            h = np.array(batch.column(2)).view(_U) ^ _U(1 << 63)
            v = np.array(batch.column(3).flatten(), np.float32).reshape(-1, wide)
            cuts = [0, *(np.flatnonzero((np.diff(group, axis=0) != 0).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                key = int(group[a, 0]), int(group[a, 1])
                for name, data, width in (("hash", h, 8), ("values", v, 4 * wide)):
                    with open(f"{folder}/{key[0]}.{name}", "r+b") as f:
                        f.seek(at[key] * width)
                        f.write(data[a:b].tobytes())
                at[key] += b - a
        yield pa.RecordBatch.from_arrays([pa.array([sum(at.values()) - sum(first.values())])], ["n"])

    done = table.repartition("part", "shard").sortWithinPartitions("part", "shard", "h").mapInArrow(write, "n long").agg(F.sum("n")).first()[0]
    if (done or 0) != sum(sizes.values()):
        raise RuntimeError(f"{done} of {sum(sizes.values())} n-grams were written")
    return StoredModels(langs, folder, sizes)


class Calibration:
    """P(the winner is right) from the margin to the second best and the text's length, by a small logistic regression."""

    def __init__(self):
        self.w = np.array([0.0, 4.0])

    @staticmethod
    def inputs(ce: np.ndarray, n: np.ndarray) -> np.ndarray:
        best = np.sort(ce, axis=1)
        margin = best[:, 1] - best[:, 0] if ce.shape[1] > 1 else np.ones(len(ce))
        return np.stack([np.ones(len(ce)), margin * np.sqrt(np.maximum(n, 1))], axis=1)

    def fit(self, x: np.ndarray, right: np.ndarray) -> None:
        for _ in range(25):  # Newton steps with a weak prior around the start
            p = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
            grad = x.T @ (p - right) + 0.1 * (self.w - [0.0, 4.0])
            hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
            self.w = self.w - np.linalg.solve(hess, grad)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))


def fit(docs: DataFrame) -> tuple[Models, Calibration]:
    """The models of the languages in docs (text, lang), and their calibration."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"), "text", F.col("lang").cast("string").alias("lang"))
    share = int(min(CALIBRATION_SHARE, CALIBRATION_DOCS / max(1, known.count())) * (1 << 30))
    counts = C.cut(count(known.where(F.col("h") >= share)))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    models = store(kneser_ney(counts, langs), langs) if langs else Models(pd.DataFrame({"lang": [], "gram": [], "n": []}))
    calibration = Calibration()
    if models.langs:
        part = known.where(F.col("h") < share)

        def run(batches):
            for block in C.blocks(batches):
                ce, n = models.entropy(block.column(0).to_pylist())
                right = np.array(models.langs, object)[ce.argmin(axis=1)] == np.array(block.column(1).to_pylist(), object)
                x = Calibration.inputs(ce, n)[n > 0]
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(right[n > 0].astype(bool))], ["m", "ok"])

        ins = part.select("text", "lang").mapInArrow(run, "m double, ok boolean").toPandas().sort_values(["m", "ok"])
        if len(ins):
            calibration.fit(np.stack([np.ones(len(ins)), ins["m"]], axis=1), ins["ok"].to_numpy(float))
    return models, calibration


def predict(docs: DataFrame, fitted: tuple[Models, Calibration]) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, cross_entropy) of every document."""
    models, calibration = fitted

    def run(batches):
        for block in C.blocks(batches, 1 << 20):
            ce, n = models.entropy(block.column(1).to_pylist())
            if models.langs:
                ok = n > 0
                lang = np.where(ok, np.array(models.langs, object)[ce.argmin(axis=1)], "und")
                score = np.where(ok, calibration.score(Calibration.inputs(ce, n)), 0.0)
                best = np.where(ok, ce.min(axis=1), 0.0)
            else:
                lang, score, best = np.full(len(n), "und", object), np.zeros(len(n)), np.zeros(len(n))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(lang.tolist(), pa.string()), pa.array(np.round(score, 9)), pa.array(score < REJECT), pa.array(np.round(best, 6))], ["doc_id", "lang_pred", "score", "rejected", "cross_entropy"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    held = C.held_out(F.col("doc_id"), 4, 2)
    fitted = fit(docs.where(~held))
    return predict(docs, fitted).select("doc_id", C.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
