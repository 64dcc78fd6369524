"""Secret scans: candidate strings and a random forest that removes false positives, in DataFrame functions only.

A candidate is a private-key block (PEM), a value of 4 or more visible characters that a key word is assigned to or that
stands in quotes after a key word, a key with a known prefix, or a run of 16 or more key characters with a digit in it;
values without a key word, prefix or digit, and assigned values with spaces, are none. Its features are length, character shares and
transitions, dictionary coverage, the path (the `source` column) and the neighbouring words. The forest is grown by
Spark's own random forest over labelled findings and then written out as one SQL expression (nested conditions), so that
scoring is part of the scan: no join, no shuffle of texts, no Python on the executors. Labelled findings may be passed
in; without them a labelled set is generated from the formats of common keys and of common look-alikes.

Defined cases: null and empty texts have no candidates; a null source counts as an empty path; candidates never overlap; of
forms that begin at one place (ties) the first in the order above is taken; a score of exactly 0.5 is a secret; texts and candidates of
any length are taken whole; repeated rows are scanned each on its own; an empty table gives no findings, and without
findings to learn from `train` raises Spark's error. Only doc_id, text and source are read by `scan`; `redact` passes all
columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common as C
from quarry.llm.quality_rules import let

RUN = r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*[0-9])[A-Za-z0-9_+/\-]{16,}={0,2}"
PREFIXED = r"(?<![A-Za-z0-9_+/\-])(?:AKIA|ASIA|gh[pousr]_|sk_live_|xox[abprs]-|AIza|glpat-)[A-Za-z0-9_+/\-]{12,}={0,2}"
PEM = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|[A-Za-z0-9+/=\s]*[A-Za-z0-9+/=]|)"
_WORDS = r"(?i:passwo?r?d|passphrase|pwd|secret|token|api.?key|access.?key|private.?key|auth|credential)s?"
#: The short look-behinds come first: they fail at nearly every place, the long ones are costly.
_QUOTED = "|".join(rf"(?<={q})(?<={_WORDS}[^A-Za-z0-9\r\n]{{0,6}}{q})[^\s{q}]{{4,}}(?={q})" for q in "\"'`")
_ASSIGNED = rf"(?<=[=:>]\s{{0,3}})(?<={_WORDS}[\"'`]?\s{{0,3}}(?:[:=]=?|=>)\s{{0,3}})[^\s\"'`]\S{{3,}}(?<![.,;\"'`])"
CANDIDATE = f"{PEM}|{_QUOTED}|{_ASSIGNED}|{PREFIXED}|{RUN}"
NEAR = 48  # characters looked at on either side
TREES, DEPTH, FINDINGS, SEED = 15, 6, 6_000, 7
NEXT = 12  # of these, so many where a word speaks against a secret
REDACTED = "[SECRET]"
DRAWN = {"raw": "ABcdptuvwxyz", "plain": "Cghikmnoqrsy", "word": "abDEFGHIJKLMNefghjklmn"}  # salts of the generated findings, a character each
#: Words that mark a key, a look-alike, and common parts of identifiers.
KEY_WORDS = r"(passwo?r?d|passphrase|pwd|secret|token|api.?key|access.?key|private.?key|auth|credential)s?[^a-z]{0,6}$"
LOOKALIKE_WORDS = r"example|sample|dummy|placeholder|your[_\-]|x{6}|changeme|uuid|commit|checksum|sha1|sha256|md5|card|phone|order|invoice"
KEY_PREFIX = r"^(AKIA|ASIA|gh[pousr]_|sk_live_|xox[abprs]-|AIza|glpat-)"
DICTIONARY = (
    "about", "access", "account", "action", "active", "after", "all", "and", "answer", "app", "array", "back", "base", "before", "begin",
    "bin", "block", "board", "book", "box", "build", "button", "byte", "call", "case", "change", "char", "check", "city", "class",
    "client", "close", "code", "color", "column", "config", "content", "copy", "count", "create", "data", "date", "day", "default", "delete",
    "device", "dir", "docs", "down", "draft", "edit", "end", "entry", "error", "event", "example", "export", "field", "file", "filter",
    "find", "first", "flag", "folder", "font", "for", "form", "from", "function", "general", "get", "good", "group", "hand", "handle",
    "head", "height", "help", "home", "host", "house", "http", "image", "import", "index", "info", "ing", "input", "item", "job",
    "label", "language", "last", "layer", "left", "length", "level", "lib", "light", "line", "link", "list", "load", "local", "lock",
    "log", "long", "main", "make", "manager", "map", "mark", "max", "member", "message", "method", "min", "model", "module", "name",
    "new", "next", "node", "note", "number", "object", "open", "option", "order", "output", "package", "page", "panel", "part", "path",
    "place", "point", "power", "print", "process", "product", "project", "public", "python", "query", "read", "record", "report", "request", "result",
    "right", "root", "rule", "run", "save", "search", "send", "server", "service", "set", "short", "side", "site", "size", "some",
    "sort", "source", "start", "state", "status", "string", "system", "table", "tag", "target", "task", "test", "text", "the", "time",
    "tion", "title", "tree", "type", "under", "update", "user", "usr", "value", "version", "view", "water", "web", "width", "with",
    "word", "work", "world", "write", "www",
)
FEATURES = ("length", "digits", "upper", "lower", "symbols", "distinct", "runs", "hexadecimal", "dictionary", "prefix", "key_word", "assigned", "quoted", "lookalike", "test_path", "marks", "code", "pem", "vowels")


def features(c: Column, left: Column, right: Column, path: Column) -> dict[str, Column]:
    """Features of a candidate with its neighbourhood and path."""
    n = F.length(c)
    part = lambda keep: F.length(F.regexp_replace(c, f"[{keep[1:]}]" if keep[0] == "^" else f"[^{keep}]", "")) / n
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "0")
    flag = lambda x: F.when(x, F.lit(1.0)).otherwise(F.lit(0.0))
    return {
        "length": n.cast("double"),
        "digits": part("0-9"), "upper": part("A-Z"), "lower": part("a-z"), "symbols": part(r"_+/\-="),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "runs": F.length(runs) / n,
        "hexadecimal": flag(c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$")),
        "dictionary": F.lit(1.0) - F.length(F.regexp_replace(F.lower(c), "|".join(DICTIONARY), "")) / n,
        "prefix": flag(c.rlike(KEY_PREFIX)),
        "key_word": flag(F.lower(left).rlike(KEY_WORDS)),
        "assigned": flag(left.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(left.rlike(r"[\"']$")),
        "lookalike": flag(F.lower(F.concat(F.right(left, F.lit(NEXT)), c, F.left(right, F.lit(NEXT)))).rlike(LOOKALIKE_WORDS)),
        "marks": part(r"^A-Za-z0-9_+/\-="),
        "code": flag(c.rlike(r"^[\w.]+[(\[]|\(\)|^[$%]?[{<(\[]|^[$%][A-Za-z_]+%?$|^[a-z_]+(\.[a-z_]+)+|^[*.xX_\-]+$|://|->|::")),
        "pem": flag(c.rlike("^-----BEGIN ")),
        "vowels": F.length(F.regexp_replace(F.lower(c), "[^aeiou]", "")) / n,
        "test_path": flag(F.lower(path).rlike("test|example|sample|fixture|docs?/")),
    }


def generated_findings(spark: SparkSession, n: int = FINDINGS, start: int = 0) -> DataFrame:
    """Labelled findings (candidate, left, right, path, label), drawn by hash from the row numbers start to start + n.

    Paths are drawn apart from the labels, so the forest learns nothing from them here; real findings may teach it to."""
    each = lambda kind, f: F.transform(F.split(F.lit(DRAWN[kind]), ""), f).alias(kind)  # noqa: E731  one expression for all draws of a kind, else they swell the driver's plan
    raw_of = lambda *salt: F.sha2(F.concat(F.col("id").cast("string"), *salt), 256)
    words = F.split(F.lit(" ".join(DICTIONARY)), " ")
    drawn = spark.range(start, start + n, 1, 1).select(
        "id",
        each("raw", lambda s: raw_of(s)),
        each("plain", lambda s: F.regexp_replace(F.base64(F.unhex(F.concat(raw_of(s), raw_of(s, F.lit("'"))))), "[^A-Za-z0-9]", "")),
        each("word", lambda s: F.element_at(words, (F.pmod(F.xxhash64(s, F.col("id")), F.lit(len(DICTIONARY))) + 1).cast("int"))),
    )
    pick = lambda kind: lambda salt: F.get(F.col(kind), F.lit(DRAWN[kind].index(salt)))
    raw, plain, word = pick("raw"), pick("plain"), pick("word")
    digits = F.translate(raw("d"), "abcdef", "012345")
    some = lambda low, high: (F.lit(low) + F.pmod(F.xxhash64("id"), F.lit(high - low + 1))).cast("int")
    cut = lambda x, k: F.substr(x, F.lit(1), k if isinstance(k, Column) else F.lit(k))
    letters = lambda salt, k: F.translate(cut(raw(salt), k), "0123456789abcdef", "qwertyuiopzsdgjk")
    text = F.concat(F.lit("then "), word("a"), F.lit(" and the "), word("b"), F.lit(" "))
    kinds = [  # label, candidate, text before, text after
        (1, cut(raw("p"), some(16, 40)), F.concat(text, F.lit("password=")), F.lit(" ")),
        (1, cut(raw("t"), some(32, 64)), F.concat(text, F.lit('token = "')), F.lit('" ')),
        (1, F.concat(F.lit("AKIA"), cut(F.upper(plain("k")), 16)), text, F.lit(" ")),
        (1, F.concat(F.lit("ghp_"), cut(plain("g"), 36)), text, F.lit(" ")),
        (1, cut(plain("s"), some(24, 48)), F.concat(text, F.lit("secret: ")), F.lit("\n")),
        (1, cut(plain("m"), some(20, 40)), F.concat(text, F.lit("api_key='")), F.lit("' ")),
        (1, F.concat(cut(F.lower(plain("h")), some(5, 9)), cut(digits, 1), cut(plain("i"), some(2, 6))), F.concat(text, F.lit("password=")), F.lit(" ")),
        (1, F.concat(cut(plain("n"), some(4, 9)), F.lit("&"), cut(digits, 1), cut(plain("o"), some(2, 6))), F.concat(text, F.lit('password = "')), F.lit('"\n')),
        (1, F.concat(cut(plain("q"), some(3, 6)), F.lit("!"), cut(digits, 1), cut(plain("r"), some(2, 5)), F.lit("@$"), cut(plain("y"), some(3, 5))), F.concat(text, F.lit("pwd='")), F.lit("' ")),
        (1, letters("A", some(16, 40)), F.concat(text, F.lit("secret: ")), F.lit(" ")),
        (1, F.concat(F.lit("AKIA"), F.upper(letters("B", 16))), text, F.lit(" ")),
        (1, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), plain("C"), F.lit("\n-----END RSA PRIVATE KEY-----")), text, F.lit("\n")),
        (1, F.element_at(F.array(*[F.lit(f"-----BEGIN {k}PRIVATE KEY-----") for k in ("RSA ", "EC ", "OPENSSH ", "")]), some(1, 4)), text, F.lit("\n")),
        (0, word("D"), F.concat(text, F.lit("password: ")), F.lit(" and then")),
        (0, F.concat(word("E"), word("F")), F.concat(text, F.lit("secret: ")), F.lit(" is the")),
        (0, F.concat(word("G"), F.lit("-"), word("H")), F.concat(text, F.lit('token "')), F.lit('" ')),
        (0, F.concat(F.lit("get_"), word("I"), F.lit("()")), F.concat(text, F.lit("token = ")), F.lit("\n")),
        (0, F.concat(word("J"), F.lit("."), word("K"), F.lit("["), word("L"), F.lit("]")), F.concat(text, F.lit("password = ")), F.lit("\n")),
        (0, F.concat(F.lit("${"), F.upper(word("M")), F.lit("}")), F.concat(text, F.lit("password=")), F.lit("\n")),
        (0, F.concat(F.lit("<"), word("N"), F.lit(">")), F.concat(text, F.lit("api_key: ")), F.lit("\n")),
        (0, F.element_at(F.array(*[F.lit(x) for x in ("None", "null", "true", "False", "********", "required", "string", "invalid")]), some(1, 8)), F.concat(text, F.lit("password=")), F.lit(" ")),
        (0, cut(digits, some(16, 19)), text, F.lit(". ")),
        (0, cut(raw("c"), 40), F.concat(text, F.lit("commit ")), F.lit(" ")),
        (0, F.concat_ws("-", cut(raw("u"), 8), cut(raw("v"), 4), cut(raw("w"), 4), cut(raw("x"), 4), cut(raw("y"), 12)), F.concat(text, F.lit("id ")), F.lit(" ")),
        (0, F.concat_ws("_", word("e"), word("f"), word("g"), word("h"), cut(digits, 2)), text, F.lit(" ")),
        (0, F.concat_ws("/", word("j"), word("k"), word("l"), word("m"), F.concat(word("n"), cut(digits, 1))), text, F.lit(" ")),
        (0, F.concat(F.lit("your-api-key-"), cut(digits, 4)), F.concat(text, F.lit("api_key=")), F.lit(" ")),
        (0, F.concat(F.lit("xxxxxxxxxxxxxxxx"), cut(digits, 2)), F.concat(text, F.lit("token = \"")), F.lit("\" ")),
        (0, cut(raw("z"), 64), F.concat(text, F.lit("sha256 ")), F.lit(" ")),
    ]
    rows = F.element_at(F.array(*[F.struct(c.alias("candidate"), a.alias("left"), b.alias("right"), F.lit(y).alias("label")) for y, c, a, b in kinds]), (F.pmod("id", F.lit(len(kinds))) + 1).cast("int"))
    places = ("src0", "src/main", "lib/core", "tests/data", "docs/guide", "")
    path = F.element_at(F.array(*[F.lit(x) for x in places]), (F.pmod(F.xxhash64(F.lit("path"), "id"), F.lit(len(places))) + 1).cast("int"))
    return drawn.select(rows.alias("r"), path.alias("path")).select("r.*", "path")


def train(findings: DataFrame) -> list:
    """The forest's trees as nested tuples (feature, threshold, left, right) or shares of secrets at the leaves."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    c = F.col
    rows = findings.where("candidate is not null and label is not null").select(*[v.alias(k) for k, v in features(c("candidate"), F.coalesce("left", F.lit("")), F.coalesce("right", F.lit("")), F.coalesce("path", F.lit(""))).items()], c("label").cast("double").alias("label"))
    rows = C.cut(rows)  # the forest reads them several times, and each of its plans would hold all features
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(table)

    def read(node):
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return float(stats[1] / (stats[0] + stats[1])) if len(stats) > 1 and sum(stats) else float(node.prediction())
        return node.split().featureIndex(), float(node.split().threshold()), read(node.leftChild()), read(node.rightChild())

    return [read(t._call_java("rootNode")) for t in model.trees]


def forest(trees: list, values: dict[str, Column]) -> Column:
    """The mean share of secrets over all trees, as one expression."""
    names = list(FEATURES)

    def of(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(node)
        k, threshold, left, right = node
        return F.when(values[names[k]] <= threshold, of(left)).otherwise(of(right))

    return sum((of(t) for t in trees[1:]), of(trees[0])) / len(trees)


def score_of(trees: list, c: Column, left: Column, right: Column, path: Column) -> Column:
    """Score of one candidate; the features are computed once (a lambda variable)."""
    f = features(c, left, right, path)
    return let(F.struct(*[v.cast("double").alias(k) for k, v in f.items()]), lambda s: forest(trees, {k: s[k] for k in FEATURES}))


def candidates_in(text: Column) -> Column:
    """Array of (gap, candidate, left, right): gap is the number of characters since the candidate before."""
    found = F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("m"), F.split(text, CANDIDATE, -1).alias("p"))
    return let(found, lambda x: F.transform(x["m"], lambda c, i: F.struct(F.length(F.get(x["p"], i)).alias("gap"), c.alias("candidate"), F.right(F.get(x["p"], i), F.lit(NEAR)).alias("left"), F.left(F.get(x["p"], i + 1), F.lit(NEAR)).alias("right"))))


def scan(docs: DataFrame, trees: list) -> DataFrame:
    """Every candidate: doc_id, begin and end (code points), its sha256, score, is_secret."""
    text = docs.where(F.col("text").rlike(CANDIDATE)).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), "text")
    text = text.withColumn("row", F.monotonically_increasing_id())  # before the rows are spread
    rows = text.select("doc_id", "path", "row", F.posexplode(candidates_in(F.col("text"))).alias("at", "c"))
    rows = rows.select("doc_id", "path", "row", "at", "c.*")
    w = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("candidate")).over(w).cast("long"))
    scored = rows.withColumn("score", F.round(score_of(trees, F.col("candidate"), F.col("left"), F.col("right"), F.col("path")), 9))
    return scored.select("doc_id", (F.col("end") - F.length("candidate")).alias("begin"), "end", F.sha2("candidate", 256).alias("candidate_sha256"), "score", (F.col("score") >= 0.5).alias("is_secret"))


def redact(docs: DataFrame, trees: list) -> DataFrame:
    """The same rows and columns with every secret in `text` replaced by REDACTED; n_chars, where present, follows."""
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    text = F.col("text")

    def put(x: Column) -> Column:
        shown = lambda c, i: F.when(score_of(trees, c, F.right(F.get(x["p"], i), F.lit(NEAR)), F.left(F.get(x["p"], i + 1), F.lit(NEAR)), path) >= 0.5, F.lit(REDACTED)).otherwise(c)
        shared = F.transform(x["m"], lambda c, i: F.concat(F.get(x["p"], i), shown(c, i)))
        return F.concat(F.array_join(shared, ""), F.element_at(x["p"], -1))

    found = F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("m"), F.split(text, CANDIDATE, -1).alias("p"))
    new = F.when(text.rlike(CANDIDATE), let(found, put)).otherwise(text)
    out = docs.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"), train(generated_findings(spark)))
