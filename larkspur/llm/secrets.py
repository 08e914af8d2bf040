"""Secret scan: candidates by pattern, false positives removed by a random forest.

The scan uses DataFrame functions only. A text's words are looked at with their neighbours; a word is a candidate if it holds a
run of ``RUN`` or more key characters (other than one character over and over), or a value of ``VALUE`` or more after a
credential's name and an ``=`` or ``:``. A word gives all its runs and all its values, but for values equal to one of its runs;
features look at ``NEAR`` characters of a word on either side of the candidate.

Features are SQL expressions: length, shares of character classes, character transitions, dictionary coverage, path marks and
neighbouring words. The dictionary are the ``DICTIONARY`` most frequent words of the texts themselves, counted over all of them
(``dictionary``); every second one measures coverage, and the others, with a few that are usual in code, make the harmless
findings, so that the forest does not meet the words it was trained on. The forest is fitted on the driver from labelled findings
(made by a seeded rule, ``labelled``; their number ``FINDINGS`` is the bound), from the same expressions, and becomes one CASE
expression a tree.

The scan shuffles nothing, counting words does, and what reaches the driver is bounded by ``DICTIONARY`` and ``FINDINGS``. Each
candidate of each word of each row gives one row; repeated rows and null ids are kept; null, empty and wordless texts give none, as
does an empty table; a text of any length is read whole; positions count words from 0; other columns are ignored.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common

RUN, VALUE, NEAR = 16, 8, 256
#: Words of the dictionary, and their least and greatest length.
DICTIONARY, SHORTEST, LONGEST = 600, 3, 12
FINDINGS, TREES, DEPTH, LEAF, SEED = 2400, 15, 6, 5, 11
THRESHOLD = 0.5

_KEYS = r"[A-Za-z0-9_+/=-]"
#: Tried only where a run begins, so a long one is read once.
_RUN = rf"(?<!{_KEYS})(?!({_KEYS})\1*+(?!{_KEYS})){_KEYS}{{{RUN},}}"
_NAME = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
#: Looked ahead, so that values may overlap: one ends at a quote, at the word's end, or before the next name and its sign. It
#: lies in the last word of what is looked at.
_ASSIGNED = rf"(?={_NAME}[\"']?\s*[:=]+\s*[\"']?([^\s\"']{{{VALUE},}}?)(?=[\"']|[,;&][A-Za-z_][A-Za-z0-9_.-]*[:=]|$)\S*$)"
_OTHER = r"(?i)(?:commit|sha-?[0-9]*|md5|hash|checksum|digest|revision|uuid|guid|build|version|isbn|etag|order|invoice|ticket|phone|card)"
#: Words usual in code, of which harmless findings are made beside those of the texts.
_CODE = "access account archive backup batch button cache class client config context count data default demo error example factory field file filter format function handler image index input item key library list log manager message method model module name number object option order output package page path project query record report request result sample server service session size source string style table task template test text time type update upload user value version view window".split()

FEATURES = ["n", "digits", "upper", "lower", "signs", "swaps", "case_swaps", "vowel_steps", "distinct", "repeats", "coverage", "hex", "uuid", "paths", "named", "other", "assigned"]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word, before2, before, holder (the word), after, candidate, rule."""
    gate = F.col("text").rlike(f"{_RUN}|{_NAME}")
    # split as the SQL function: words between spaces and control white space
    parts = docs.where(gate).select("doc_id", F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+").alias("w"))
    around = F.transform(
        "w",
        lambda x, i: F.struct(
            i.cast("long").alias("word"),
            F.coalesce(F.get("w", i - 2), F.lit("")).alias("before2"),
            F.coalesce(F.get("w", i - 1), F.lit("")).alias("before"),
            x.alias("holder"),
            F.coalesce(F.get("w", i + 1), F.lit("")).alias("after"),
        ),
    )
    near = F.filter(around, lambda s: s["holder"].rlike(_RUN) | (s["holder"].rlike(_NAME) & s["holder"].rlike("[:=]")) | (s["before"].rlike("[:=]") & (s["before"].rlike(_NAME) | s["before2"].rlike(_NAME))))
    rows = parts.select("doc_id", F.explode(near).alias("s")).select("doc_id", "s.*")
    return chosen(rows)


def chosen(rows: DataFrame) -> DataFrame:
    """A row for each candidate of words with their neighbours: ordinal (within the word), candidate and rule added, the holder cut to what is near."""
    runs = F.regexp_extract_all("holder", F.lit(_RUN), F.lit(0))
    values = F.regexp_extract_all(F.concat_ws(" ", "before2", "before", "holder"), F.lit(_ASSIGNED), F.lit(1))
    values = F.transform(values, lambda v: F.regexp_replace(v, r"[\"'.,;:!)\]}*%#$&|]+$", ""))
    rows = rows.withColumns({"runs": runs, "values": values})
    values = F.filter("values", lambda v: (F.length(v) >= VALUE) & ~F.array_contains("runs", v))
    found = F.concat(F.transform("runs", lambda v: F.struct(v.alias("candidate"), F.lit("run").alias("rule"))), F.transform(values, lambda v: F.struct(v.alias("candidate"), F.lit("assigned").alias("rule"))))
    rows = rows.select("*", F.posexplode(found).alias("ordinal", "found")).drop("runs", "values").select("*", "found.*").drop("found")
    start = F.expr(f"greatest(instr(holder, candidate) - {NEAR}, 1)")
    return rows.withColumn("holder", F.substring("holder", start, F.length("candidate") + 2 * NEAR))


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of a-z in all texts, by frequency (ties: by the word)."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word").between(SHORTEST, LONGEST))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return [r["word"] for r in counted.orderBy(F.col("n").desc(), "word").limit(size).collect()]


def features(rows: DataFrame, known: list[str]) -> DataFrame:
    """Add the FEATURES as doubles; ``known`` are the words that coverage counts."""
    x, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1)).cast("double")
    low = F.lower(x)

    def share(pattern: str, of: Column = x) -> Column:
        return F.regexp_count(of, F.lit(pattern)) / n

    covered = F.array_join(F.regexp_extract_all(low, F.lit("(" + "|".join(sorted(known, key=len, reverse=True)) + ")"), F.lit(1)), "") if known else F.lit("")
    context = F.concat_ws(" ", "before2", "before", F.expr("substring(holder, 1, greatest(instr(holder, candidate) - 1, 0))"))
    around = F.concat_ws(" ", "before2", "before", "holder", "after")
    made = {
        "n": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "signs": share("[^A-Za-z0-9]"),
        "swaps": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"),
        "case_swaps": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "vowel_steps": share("(?<=[b-df-hj-np-tv-z])[aeiou]", low),
        "distinct": F.size(F.array_distinct(F.split(x, ""))) / n,
        "repeats": share(r"(.)(?=\1)"),
        "coverage": F.length(covered) / n,
        "hex": x.rlike("^[0-9a-fA-F]+$").cast("double"),
        "uuid": x.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$").cast("double"),
        "paths": F.col("holder").rlike(r"://|[A-Za-z0-9]\.(com|org|net|io|png|jpg|html|js|css|py|txt)|^[./~]|/[A-Za-z]+/").cast("double"),
        "named": context.rlike(_NAME).cast("double"),
        "other": around.rlike(_OTHER).cast("double"),
        "assigned": context.rlike("[:=]").cast("double"),
    }
    return rows.withColumns({f: made[f].cast("double") for f in FEATURES})


def labelled(n: int, seed: int, words: list[str] = ()) -> list[dict]:
    """Findings with a label: words and neighbours, 1 for a secret, and the secret; harmless ones are made of ``words`` and those usual in code."""
    r = random.Random(seed)
    words = [*words, *_CODE]

    def of(chars: str, k: int) -> str:
        return "".join(r.choices(chars, k=k))

    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names = ["token", "secret", "password", "api_key", "apikey", "access_key", "auth", "bearer", "private_key", "credential"]

    def name() -> str:
        return r.choice(["", "", "my_", "aws_", "db-"]) + (s if (s := r.choice(names)) and r.random() < 0.7 else s.upper())

    def secret() -> tuple[str, str, str, str]:
        s = r.choice([lambda: of(hexa, r.choice([32, 40, 64])), lambda: of(alnum, r.randint(20, 44)), lambda: "AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "ghp_" + of(alnum, 36), lambda: of(alnum + "+/", 40) + "=", lambda: of(alnum + "!@#%^", r.randint(10, 18)), lambda: "sk-" + of(alnum, 32), lambda: of(hexa.upper(), 40)])()
        form = r.random()
        if form < 0.5:
            return name(), r.choice(["=", "=", ":", ":="]), f'"{s}"', s
        if form < 0.75:
            return r.choice(words), r.choice(words), f'{name()}{r.choice("=:")}{r.choice(["", chr(34)])}{s}', s
        return r.choice(words), r.choice(["Bearer", "token:", "secret:", "key:", "Authorization:"]), s, s

    def harmless() -> tuple[str, str, str, str]:
        made = r.choice(
            [
                lambda: (r.choice(["commit", "sha1", "md5", "checksum", "revision"]), r.choice(["=", ":", "is"]), of(hexa, r.choice([32, 40, 64]))),
                lambda: (r.choice(words), r.choice(["uuid", "id", "guid"]), "-".join(of(hexa, k) for k in (8, 4, 4, 4, 12))),
                lambda: (r.choice(words), r.choice(words), "https://" + "/".join([r.choice(words) + ".com", *r.choices(words, k=3), of("0123456789", r.randint(3, 9))])),
                lambda: (r.choice(words), r.choice(words), "_".join(r.choices(words, k=3)) + of("0123456789", 2)),
                lambda: (r.choice(words), r.choice(words), "".join(w.title() for w in r.choices(words, k=4)) + of("0123456789", 1)),
                lambda: (name(), r.choice("=:"), r.choice(["your_token_here_123", "xxxxxxxxxxxxxxxx", "changeme123456", "example_secret_1234", "<insert-key-here>", "${SECRET_TOKEN_1}", "00000000000000000000", "1234567890123456", "password12345678"])),
                lambda: (r.choice(words), r.choice(["card", "order", "phone", r.choice(words)]), of("0123456789", r.randint(16, 20))),
                lambda: (name(), r.choice(["is", "for", "=", ":"]), r.choice(words) + r.choice(words) + of("0123456789", r.randint(0, 3))),
                lambda: (r.choice(words), r.choice(words), "/".join(["", *r.choices(words, k=4)]) + of("0123456789", 2) + ".png"),
                lambda: (r.choice(words), r.choice(words), of("ABCDEFGHJKMN", 4) + "-" + "-".join(of("0123456789", 4) for _ in range(3))),
                lambda: (r.choice(words), r.choice(words), "=" * r.randint(10, 30) + of("0123456789", 1) + "=" * 6),
                lambda: (r.choice(words), r.choice(words), "".join(r.choices(words, k=r.randint(3, 6))).capitalize()),
            ]
        )
        return *made(), ""

    out = []
    for i in range(n):
        a, b, c, s = secret() if i % 2 else harmless()
        c += r.choice(["", "", ",", ".", "###", "***", "!!"])
        row = {"before2": a, "before": b, "holder": c, "after": r.choice(words), "secret": s, "label": i % 2}
        out.append({k: v.upper() for k, v in row.items() if k != "label"} | {"label": i % 2} if r.random() < 0.05 else row)
    return out


def findings(spark: SparkSession, words: list[str], n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """The labelled findings as rows with features, given a dictionary."""
    schema = "array<struct<before2:string,before:string,holder:string,after:string,secret:string,label:int>>"
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(labelled(n, seed, words[1::2]))), schema)).alias("s")).select("s.*")
    # beside its secret a word may hold other candidates, such as a long name
    part = F.contains("secret", "candidate") | F.contains("candidate", "secret")
    return features(chosen(rows), words[::2]).withColumn("label", F.when(part, F.col("label")).otherwise(0))


Node = tuple  # (share of secrets,) or (feature number, threshold, at most, above)


def grow(x: np.ndarray, y: np.ndarray, g: np.random.Generator, depth: int) -> Node:
    """A tree by Gini impurity over random features."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAF or share in (0.0, 1.0):
        return (share,)
    best: tuple | None = None
    for f in g.choice(x.shape[1], size=int(np.ceil(np.sqrt(x.shape[1]))) + 1, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        left = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (left >= LEAF) & (len(y) - left >= LEAF)
        if not ok.any():
            continue
        a, b = ones[:-1] / left, (ones[-1] - ones[:-1]) / (len(y) - left)
        cost = np.where(ok, left * a * (1 - a) + (len(y) - left) * b * (1 - b), np.inf)
        k = int(cost.argmin())
        if best is None or cost[k] < best[0]:
            best = (cost[k], int(f), float((v[k] + v[k + 1]) / 2))
    if best is None:
        return (share,)
    _, f, t = best
    low = x[:, f] <= t
    return (f, t, grow(x[low], y[low], g, depth - 1), grow(x[~low], y[~low], g, depth - 1))


def forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Node]:
    g = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = g.integers(0, len(y), len(y))
        out.append(grow(x[rows], y[rows], g, depth))
    return out


def evaluate(node: Node, row) -> float:
    while len(node) > 1:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node[0]


def as_sql(node: Node) -> str:
    if len(node) == 1:
        return f"{node[0]:.6f}D"
    return f"CASE WHEN {FEATURES[node[0]]} <= {node[1]!r}D THEN {as_sql(node[2])} ELSE {as_sql(node[3])} END"


def fitted(spark: SparkSession, words: list[str]) -> list[Node]:
    """The forest of the default findings, given a dictionary."""
    rows = findings(spark, words).select("label", *FEATURES).collect()
    data = np.array([list(r) for r in rows], dtype=float)
    return forest(data[:, 1:], data[:, 0])


def scan(docs: DataFrame, threshold: float = THRESHOLD, words: list[str] | None = None) -> DataFrame:
    """doc_id, word, rule, candidate, score, is_secret of every candidate of every row; ``words``: a dictionary in place of the texts' own."""
    words = dictionary(docs) if words is None else words
    trees = fitted(docs.sparkSession, words)
    rows = features(candidates(docs.select("doc_id", "text")), words[::2])
    total = " + ".join(f"({as_sql(t)})" for t in trees)
    scored = rows.withColumn("score", F.round(F.expr(f"({total}) / {len(trees)}D"), 6))
    return scored.select("doc_id", "word", "rule", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for secrets in every document, by digest, with the forest's verdict."""
    out = scan(common.documents(spark, sf_dir))
    return out.select("doc_id", "word", "rule", F.sha2("candidate", 256).alias("secret_sha256"), "score", "is_secret")


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
