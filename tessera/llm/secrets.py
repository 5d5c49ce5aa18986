"""Secret scan with a random forest that removes false positives.

Patterns propose candidates in whole texts, each to the end of its run; a random forest (Spark ML), trained on labelled
findings, decides by length, character transitions, dictionary coverage, path and neighbouring words.  One dictionary
serves for training and for deciding: fixed words, or a set that is given (``corpus_words`` makes one from a corpus), so a
document's verdict doesn't depend on the others.  The trained trees and the dictionary are some thousand numbers and
words: they travel with the task closure, and texts are scanned, decided and redacted in one pass without a shuffle.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import checkpointed, lean, named

#: Shapes of well-known keys, by kind; the last two are general.  Runs are possessive: they have no
#: greatest length and take linear time.  Of a private key and a signed token, only the first part stands here.
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "cloud_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "code_host_token": r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}+|glpat-[A-Za-z0-9_-]{20,}+)",
    "chat_token": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+",
    "signed_token": r"(?<![A-Za-z0-9])eyJ(?=[A-Za-z0-9_-]{10})",
    "url_password": r"://[^\s:/@\"'<>]*+:(?P<between>[^\s/@\"'<>]{3,}+)@",
    "assigned": r"(?i:(?<![a-z0-9])(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret))[\"']?[ \t]{0,3}[:=][ \t]{0,3}(?:(?P<mark>[\"'])(?P<quoted>[^\s\"']{6,}+)(?P=mark)|[\"']?(?P<value>[A-Za-z0-9+/=_.~!#%^&*@$-]{8,}+))",
    "random": r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]{0,40}[0-9]|(?=[A-Za-z0-9+/=_-]{201})[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/=_-]{24,}+",
}
KINDS = list(PATTERNS)
SCANNER = re.compile("|".join(f"(?P<{kind}>{PATTERNS[kind]})" for kind in KINDS if kind not in ("private_key", "signed_token")))
BEGIN, END = (re.compile(PATTERNS["private_key"].replace("BEGIN", word)) for word in ("BEGIN", "END"))
#: What follows a key's first line where its last one is missing: header lines, then long runs of base64 (ends of
#: lines may be escaped), then a shorter one if it fills its line or is no plain word.
BODY = re.compile(
    r"(?:[\r\n]++[A-Za-z-]++: [^\r\n]*+)*+(?:(?:\\[rn]|[\s\"',;])*+[A-Za-z0-9+/=]{24,}+)++"
    r"(?:(?:\\[rn]|[\r\n])++[ \t]*+[A-Za-z0-9+/=]++(?=[ \t\"',;]*+(?:\\[rn]|[\r\n]|\Z))|[ \t]++(?![A-Za-z]?[a-z]*+(?![A-Za-z0-9+/=]))[A-Za-z0-9+/=]++)?"
)
HEAD, RUN, PARTS = re.compile(PATTERNS["signed_token"]), re.compile("[A-Za-z0-9_-]*+"), re.compile(r"(?:\.[A-Za-z0-9_-]{10,}+){2}")
PIECE = 200  # longer values are judged in parts of about this length
KEY_WORDS = {"token", "secret", "password", "passwd", "key", "apikey", "api_key", "auth", "bearer", "credential", "credentials", "access"}
HARMLESS_WORDS = {"example", "sample", "dummy", "test", "placeholder", "commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "id", "revision", "changeme", "version"}
HARMLESS_PATHS = ("test", "example", "sample", "doc", "readme", "fixture", "lock")
DICTIONARY = frozenset("the and for you with this that have from your password example changeme secret token value key name user admin test sample none null true false config server default here insert enter replace data file path index http https www com org xxx abc".split())
#: The corpus's own words in the dictionary: how many, their lengths, and how often each must be found.
CORPUS_WORDS, WORD_LENGTHS, LEAST_FOUND = 4000, (4, 12), 20
FEATURES = (
    ["length", "log_length", "transitions", "digit_share", "upper_share", "lower_share", "other_share", "hex_share", "entropy", "distinct_share", "longest_repeat", "coverage", "vowel_share", "dashes", "is_uuid", "near_key_word", "near_harmless_word", "harmless_path", "quoted"]
    + [f"kind_{k}" for k in KINDS]
)


def char_class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def coverage(value: str, words: frozenset[str]) -> float:
    """Share of the characters that words of the dictionary cover."""
    low, done, covered = value.lower(), 0, 0
    for i in range(len(low)):
        longest = next((k for k in range(min(WORD_LENGTHS[1], len(low) - i), 2, -1) if low[i : i + k] in words), 0)
        if i + longest > done:
            covered += i + longest - max(done, i)
            done = i + longest
    return covered / max(1, len(low))


def corpus_words(docs: DataFrame, text_col: str = "text", size: int = CORPUS_WORDS, least: int = LEAST_FOUND) -> frozenset[str]:
    """The fixed words and the ``size`` (or some fewer) most frequent words of plain letters, found ``least`` times or more.

    All documents are counted, whole; a word counts once a document for each punctuation after it.  How many words
    there are of each frequency, in steps of about one hundredth, tells from which on ``size`` of them are enough:
    beside those counts only the dictionary's own words come to the driver.
    """
    words = F.array_distinct(F.split(F.lower(F.replace(named(text_col), F.lit("\n"), F.lit(" "))), " "))
    plain = docs.select(F.explode(words).alias("word")).select(F.rtrim("word", F.lit(",.;:!?)\"'")).alias("word"))
    counted = plain.where(F.length("word").between(*WORD_LENGTHS) & F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    often = checkpointed(counted.where(F.col("n") >= least).withColumn("step", F.floor(F.log2("n") * 64)))
    total, first = 0, None
    for step, n in sorted(((r.step, r["count"]) for r in often.groupBy("step").count().collect()), reverse=True):
        total += n
        if total > size:
            break
        first = step
    return DICTIONARY | ({r.word for r in often.where(F.col("step") >= first).collect()} if first is not None else set())


def features(value: str, kind: str, before: str, after: str, path: str, words: frozenset[str] = DICTIONARY) -> list[float]:
    n = len(value)
    classes = [char_class(c) for c in value]
    counts = Counter(value)
    near = {w.strip("\"'=:,.;()<>").lower() for w in before.split()[-4:] + after.split()[:2]}
    longest = run = 1
    for a, b in zip(value, value[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    letters = sum(c.isalpha() for c in value)
    shown = [
        n,
        math.log(n),
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n,
        *(classes.count(k) / n for k in range(4)),
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        len(counts) / n,
        longest,
        coverage(value, words),
        sum(c in "aeiouAEIOU" for c in value) / max(1, letters),
        value.count("-"),
        float(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value) is not None),
        float(any(w in KEY_WORDS or w.endswith(("_key", "_token", "_secret")) for w in near)),
        float(bool(near & HARMLESS_WORDS)),
        float(any(p in path.lower() for p in HARMLESS_PATHS)),
        float(before[-1:] in "\"'" and after[:1] in "\"'" and bool(before) and bool(after)),
        *(kind == k for k in KINDS),
    ]
    return [float(x) for x in shown]


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of proposed secrets, leftmost first, in code points; all but private keys stay outside those."""
    at = 0
    for a, b in private_keys(text):
        yield from between_keys(text, at, a)
        yield a, b, "private_key"
        at = b
    yield from between_keys(text, at, len(text))


def private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Keys from the BEGIN line to the END line, or to the end of their base64 if another key or nothing follows."""
    begin = BEGIN.search(text)
    end = END.search(text) if begin else None
    while begin:
        after = BEGIN.search(text, begin.end())
        if end and end.start() < begin.end():
            end = END.search(text, begin.end())
        if end and (not after or end.start() < after.start()):
            stop = end.end()
        else:
            body = BODY.match(text, begin.end(), after.start() if after else len(text))
            stop = body.end() if body else begin.end()
        yield begin.start(), stop
        begin = after


def between_keys(text: str, at: int, stop: int) -> Iterator[tuple[int, int, str]]:
    """candidates of a part of the text."""
    signed = signed_tokens(text, at, stop)
    token, m = next(signed, None), SCANNER.search(text, at, stop)
    while token or m:
        if token and token[0] < at:
            token = next(signed, None)
        elif m and m.start() < at:
            m = SCANNER.search(text, at, stop)
        elif token and (not m or token[0] <= m.start()):
            yield *token, "signed_token"
            at = token[1]
        else:
            kind = next(k for k in KINDS if k in SCANNER.groupindex and m[k] is not None)
            yield *m.span(next((g for g in ("between", "quoted", "value") if m[g] is not None), 0)), kind
            at = m.end()


def signed_tokens(text: str, at: int, stop: int) -> Iterator[tuple[int, int]]:
    """All places where a signed token may begin, each with its end; what follows a run is looked at once."""
    run = end = 0
    for m in HEAD.finditer(text, at, stop) if text.find("eyJ", at, stop) >= 0 else ():
        if m.start() >= run:
            run = RUN.match(text, m.start(), stop).end()
            parts = PARTS.match(text, run, stop)
            end = parts.end() if parts else 0
        if end:
            yield m.start(), end


def describe(text: str, found: tuple[int, int, str], path: str, words: frozenset[str] = DICTIONARY) -> list[list[float]]:
    """Features of the parts of a candidate; of a private key, its first line tells."""
    begin, end, kind = found
    if kind == "private_key":
        end = BEGIN.match(text, begin).end()
    before, after, parts = text[max(0, begin - 60) : begin], text[end : end + 40], -(-(end - begin) // PIECE)
    cuts = [begin + (end - begin) * i // parts for i in range(parts + 1)]
    return [features(text[a:b], kind, before, after, path, words) for a, b in zip(cuts, cuts[1:], strict=False)]


def labelled_findings(n: int, seed: int) -> Iterator[tuple[str, str, bool]]:
    """Generated (text, path, whether its candidate is a secret)."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choices(letters, k=k))
    mixed, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    words = ["the", "server", "and", "then", "value", "of", "user", "load", "from", "with"]
    spoken = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    chosen = lambda: rng.choice([str.capitalize, str])(spoken()) + rng.choice([pick("0123456789", rng.randint(1, 4)) + pick("!#%&*$?", rng.randint(0, 2)) + pick(mixed, rng.randint(2, 4)), pick("!#%&*$?", 1) + spoken() + pick("0123456789", 2)])
    address = lambda value: f"{rng.choice(['postgres', 'mysql', 'amqp', 'https', 'redis'])}://{rng.choice(['app', 'user', 'root', 'svc', ''])}:{value}@{rng.choice(['db', 'host', 'queue'])}{rng.choice(['.internal', '', ':5432'])}/{rng.choice(words)}"
    for _ in range(n):
        before, after = " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=2))
        path = rng.choice(["src0", "src7", "app/config.py", "deploy.env", "web", "settings.yml"])
        name = rng.choice(["token", "secret", "api_key", "password", "access_key", "client_secret"])
        eq = rng.choice([" = ", "=", ": "])
        if rng.random() < 0.5:
            value = rng.choice([pick(hexes, 40), pick(hexes, 32), pick(mixed, rng.randint(16, 48)), pick(mixed + "+/", 44), pick(mixed + "_-", 30)])
            text = rng.choice([f'{name}{eq}"{value}"', f"{name}{eq}{value}", f'{name}{eq}"{chosen()}"', f"{name}{eq}{chosen()}{pick(mixed, 2)}", address(rng.choice([chosen(), value])), f"{name} {value + pick(mixed, 24)}", "AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(mixed, 36), f"xoxb-{pick('0123456789', 12)}-{pick(mixed, 24)}", f"eyJ{pick(mixed, 20)}.{pick(mixed, 60)}.{pick(mixed, 43)}", "-----BEGIN RSA PRIVATE KEY-----"])
            yield f"{before} {text} {after}", path, True
        else:
            word = rng.choice(HARMLESS)
            value = rng.choice([f"your_{name}_here_1", "x" * rng.randint(8, 30), "changeme123", "example_password_1", "<insert>your-key-value-here0", "0" * 32, "password1234", "test_secret_value_123", "*" * rng.randint(6, 12), "." * rng.randint(8, 12)])
            blank = rng.choice(["password", "pass", "pwd", "secret", "$PASSWORD", "{password}", "changeme", "xxx", "xxxxxxxx", "****", "your_password", "example", "test"])
            uuid = "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
            digest = rng.choice([pick(hexes, 40), pick(hexes, 64), pick(hexes, 32)])
            text = rng.choice([f"{name}{eq}{value}", f'{name}{eq}"{value}"', address(blank), f'{name}{eq}"{blank}"', f"{word} {digest}", f"id {uuid}", f"uuid: {uuid}", "-".join(rng.choices(words, k=8)) + "-2024", "/".join(rng.choices(words, k=7)) + "/v2", f"{name}{eq}" + ".".join(rng.choices(["config", "get", "user", "value", "default"], k=3)), pick("0123456789", 26), f"example {name}{eq}{pick(mixed, 20)}"])
            yield f"{before} {text} {after}", rng.choice([path, "tests/fixture.py", "docs/readme.md", "poetry.lock"]), False


HARMLESS = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "revision"]


class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left, right, chance."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    def chances(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, threshold, left, right, chance in self.trees:
            node = np.zeros(len(rows), "i8")
            while (inner := np.flatnonzero(feature[node] >= 0)).size:
                at = node[inner]
                node[inner] = np.where(rows[inner, feature[at]] <= threshold[at], left[at], right[at])
            total += chance[node]
        return total / len(self.trees)


def train(spark: SparkSession, findings: DataFrame, trees: int = 20, depth: int = 7, seed: int = 5) -> Forest:
    """A random forest over findings (features array<double>, label double), fitted by Spark ML."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = findings.select(array_to_vector("features").alias("features"), "label").coalesce(2).cache()
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=32, seed=seed, subsamplingRate=0.8).fit(rows)
    rows.unpersist()

    def arrays(tree) -> tuple[np.ndarray, ...]:
        out: list[list] = []

        def add(node) -> int:
            at = len(out)
            counts = node.impurityStats()
            stats = [float(counts.stats()[0]), float(counts.stats()[1])]
            out.append([-1, 0.0, 0, 0, stats[1] / max(1e-9, sum(stats))])
            if node.subtreeDepth() > 0:
                split = node.split()
                out[at][0], out[at][1] = split.featureIndex(), split.threshold()
                out[at][2], out[at][3] = add(node.leftChild()), add(node.rightChild())
            return at

        add(tree._call_java("rootNode"))
        kinds = ("i8", "f8", "i8", "i8", "f8")
        return tuple(np.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))

    return Forest([arrays(t) for t in model.trees])


_TRAINED: dict[tuple, Forest] = {}


def finding_features(labelled: DataFrame, words: frozenset[str] = DICTIONARY) -> DataFrame:
    """(features, label) of the candidates in labelled findings: text, path, is_secret."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(shown, float(real)) for t, p, real in zip(*(batch[c].to_pylist() for c in ("text", "path", "is_secret")), strict=True) for c in candidates(t) for shown in describe(t, c, p, words)]
            yield pa.record_batch({"features": pa.array([r[0] for r in rows], pa.list_(pa.float64())), "label": pa.array([r[1] for r in rows], pa.float64())})

    text, path = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "path"))
    return labelled.where("is_secret is not null").select(text, path, F.col("is_secret").cast("boolean").alias("is_secret")).mapInArrow(described, "features array<double>, label double")


def trained(spark: SparkSession, n: int = 1500, seed: int = 5, words: frozenset[str] = DICTIONARY) -> Forest:
    """The forest for ``n`` generated findings and a dictionary; once for each driver."""
    if (n, seed, words) not in _TRAINED:
        rows = spark.createDataFrame(list(labelled_findings(n, seed)), "text string, path string, is_secret boolean")
        _TRAINED[n, seed, words] = train(spark, finding_features(rows, words))
    return _TRAINED[n, seed, words]


def secrets_of(text: str, path: str, forest: Forest, sure: float, words: frozenset[str] = DICTIONARY) -> list[tuple[int, int, str, float]]:
    found = list(candidates(text))
    if not found:
        return []
    parts = [describe(text, c, path, words) for c in found]
    firsts = np.cumsum([0, *map(len, parts[:-1])])
    chances = np.maximum.reduceat(forest.chances(np.array([shown for rows in parts for shown in rows])), firsts)
    return [(a, b, k, float(p)) for (a, b, k), p in zip(found, chances, strict=True) if p >= sure]


def redacted(text: str, found: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for a, b, kind, _ in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, sure: float = 0.5, findings: int | DataFrame = 1500, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", words: frozenset[str] = DICTIONARY) -> DataFrame:
    """doc_id, n_secrets, secrets (kind:start:end, comma-joined, code points), top_score of each row.

    The forest is trained on ``findings``: a number of generated ones, or a table of labelled ones (text, path,
    is_secret), with the dictionary ``words`` that decides too.  Null and empty texts have no secrets; a missing or
    null path is empty.  Rows that repeat are judged alike, null ids are kept, an empty table gives an empty result.
    """
    forest = _forest(docs, findings, words)
    path = F.coalesce(named(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [secrets_of(t.as_py(), p, forest, sure, words) for t, p in zip(batch["text"], batch["path"].to_pylist(), strict=True)]
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "n_secrets": pa.array(map(len, found), pa.int64()),
                    "secrets": pa.array([",".join(f"{k}:{a}:{b}" for a, b, k, _ in f) for f in found], pa.string()),
                    "top_score": pa.array([round(max((x[3] for x in f), default=0.0), 6) for f in found], pa.float64()),
                }
            )

    return rows.mapInArrow(lean(run), "doc_id long, n_secrets long, secrets string, top_score double")


def _forest(docs: DataFrame, findings: int | DataFrame, words: frozenset[str]) -> Forest:
    return trained(docs.sparkSession, findings, words=words) if isinstance(findings, int) else train(docs.sparkSession, finding_features(findings, words))


def redact(docs: DataFrame, sure: float = 0.5, findings: int | DataFrame = 1500, text_col: str = "text", path_col: str = "source", size_col: str = "n_chars", words: frozenset[str] = DICTIONARY) -> DataFrame:
    """docs with each secret replaced by its kind in brackets (and ``size_col``, if there, brought up to date).

    Null texts stay null; a missing or null path is empty; rows that repeat are changed alike; columns of other names
    stay as they are; an empty table gives an empty result.
    """
    forest = _forest(docs, findings, words)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(names.index(path_col)).to_pylist() if path_col in names else [""] * len(batch)
            texts = batch.column(names.index(text_col)).to_pylist()
            new = [None if t is None else redacted(t, secrets_of(t, str(p or ""), forest, sure, words)) for t, p in zip(texts, paths, strict=True)]
            changed = batch.set_column(names.index(text_col), text_col, pa.array(new, pa.string()))
            if size_col in names:
                sizes = [n if t == s else len(s) for n, t, s in zip(batch.column(names.index(size_col)).to_pylist(), texts, new, strict=True)]
                changed = changed.set_column(names.index(size_col), size_col, pa.array(sizes, batch.schema.field(names.index(size_col)).type))
            yield changed

    return docs.mapInArrow(lean(run, text_col), docs.schema)
