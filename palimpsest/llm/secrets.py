"""Secret scans: a random forest that tells secrets from other long tokens, in DataFrame operations only.

Candidates are maximal runs of letters, digits and ``_-+/``: those of 12 and more
that have a letter and a digit, of 16 and more whose letters go from small to
capital, of 12 and more that begin as some services' keys do; signed tokens of
three such runs and dots as a whole; and whatever is assigned to a name that ends
in a word of SECRET_WORDS: a quoted value as a whole, others up to a blank, of any
length and characters. The forest looks at a candidate's length and classes of
characters, the transitions between them and between letters, how much of it
dictionary words cover, whether it is part of a path, and the words beside it. It
is trained from labelled findings, here made by a seeded generator, as no table
holds any; their words are others than those that the features look for, but for a
part of the names of things.

The trained trees become one SQL expression, evaluated where the text is: there
is no shuffle and text is read once.
"""

from __future__ import annotations

import random
import string

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = r"A-Za-z0-9_\-+/"
MASK = "<SECRET>"
THRESHOLD = 0.5
TREES, DEPTH, SEED, FINDINGS = 15, 7, 11, 2000
#: Code points beside a candidate that its features look at.
BESIDE = 48

# Words that names and prose are made of, and words beside secrets and beside harmless identifiers.
DICTIONARY = ("access", "account", "admin", "api", "app", "base", "build", "cache", "class", "client", "code", "com", "config", "content", "count", "data", "date", "default", "dev", "doc", "error", "event", "example", "file", "font", "form", "group", "handler", "home", "html", "http", "icon", "image", "index", "item", "key", "lib", "line", "list", "local", "main", "manager", "message", "model", "module", "name", "number", "object", "option", "page", "path", "point", "prod", "project", "query", "release", "request", "report", "response", "result", "server", "service", "session", "size", "source", "state", "static", "string", "style", "table", "test", "text", "time", "token", "type", "user", "value", "version", "view", "web", "width", "window")
SECRET_WORDS = ("token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "api key", "access_key", "access key", "private_key", "auth", "bearer", "credential", "aws")
PLAIN_WORDS = ("commit", "sha", "checksum", "md5", "digest", "hash", "uuid", "guid", "version", "revision", "build", "file", "image", "id", "etag", "isbn", "page", "chapter")
BEGINNINGS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "sk-", "sk_", "pk_", "rk_", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "AIza", "glpat-", "npm_", "SG.")
BIGRAMS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce", "li", "ch", "ll", "be", "ma", "si", "om", "ur", "pe", "us", "la", "ge", "di", "ac", "lo", "pa", "tr", "el", "ta", "ss", "ho", "ca", "no", "un", "il", "pr")
#: Words of which labelled findings are made, none of them among those above.
FINDING_WORDS = ("apple", "river", "green", "engine", "market", "driver", "planet", "silver", "garden", "bridge", "copper", "dragon", "filter", "gravity", "harbor", "island", "jungle", "kernel", "ladder", "magnet", "needle", "orange", "parser", "quartz", "rocket", "sample", "thread", "update", "vector", "winter", "yellow", "zebra", "buffer", "cursor", "device", "editor", "folder", "global", "header", "insert", "journal", "layout", "method", "network", "output", "parent", "queue", "render", "schema", "target", "upload", "vendor", "worker", "signal", "matrix", "branch", "column", "domain", "export", "packet")
KEY_NAMES = (*SECRET_WORDS, "client_secret", "db_password", "accessToken", "x-api-key", "auth_token", "signing_secret", "refresh_token", "smtp_password", "DB_PASSWD", "secretKey")
#: A name that ends in a word beside secrets, or with a number or one more part, and the sign that assigns; bounded, to look behind.
KEYED = r"(?i:" + "|".join(SECRET_WORDS) + r")s?(?:[_\-0-9][A-Za-z0-9_\-]{0,16}|(?-i:[A-Z])[A-Za-z0-9]{0,16})?[\"']?\s{0,3}(?::=|=>|[=:])\s{0,3}"
SIGNED = r"eyJ[A-Za-z0-9_\-]{4,}+\.[A-Za-z0-9_\-]{2,}+\.[A-Za-z0-9_\-]{2,}+"
BEGUN = "(?:" + "|".join(x.replace(".", r"\.") for x in BEGINNINGS) + rf")[{RUN}.]{{8,}}+(?<!\.)"
WITH_DIGITS = rf"(?=[A-Za-z_\-+/]*+[0-9])(?=[0-9_\-+/]*+[A-Za-z])[{RUN}]{{12,}}+"
MIXED = rf"(?=[A-Za-z_\-+/]*?[a-z][A-Z])[{RUN}]{{16,}}+"
LONG = rf"(?<![{RUN}])(?:{SIGNED}|{BEGUN}|{WITH_DIGITS}|{MIXED})"
VALUES = "|".join((*(rf"(?<={KEYED}{q})[^{q}\\\r\n]*+(?:\\.[^{q}\\\r\n]*+)*+(?={q})(?<!{q})" for q in ('"', "'")), rf"(?<={KEYED})(?![=>:\"'])[^\s\"',;]++"))
#: The first test looks at few characters, as it is made everywhere. Texts without KEYED have candidates of LONG only.
CANDIDATE = rf"(?<=[=:>\s\"'])(?<=[=:>]\s{{0,3}}[\"']?)(?:{VALUES})|{LONG}"
FEATURES = ("length", "digits", "upper", "hex", "changes", "covered", "bigrams", "vowels", "slashes", "marks", "prefix", "secret_word", "plain_word", "assigned", "quoted", "in_path")


def features(c: Column, before: Column, after: Column) -> list[Column]:
    """In the order of FEATURES. All are defined for any strings."""
    n = F.char_length(c)
    kept = lambda pattern: F.char_length(F.regexp_replace(c, pattern, "")) / n
    left, near = F.lower(F.right(before, F.lit(BESIDE))), F.right(before, F.lit(4))
    has = lambda text, words: F.when(text.rlike("(?:^|[^a-z])(?:" + "|".join(words) + ")(?:[^a-z]|$)"), 1.0).otherwise(0.0)
    changes = F.char_length(F.regexp_replace(c, r"[0-9]++|[a-z]++|[A-Z]++|[^0-9a-zA-Z]++", "x")) / n
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    return [
        F.least(n, F.lit(200)).cast("double"),
        kept(r"[^0-9]++"),
        kept(r"[^A-Z]++"),
        flag(c.rlike(r"^[0-9a-fA-F]++$")),
        changes,
        1 - F.char_length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / n,
        1 - F.char_length(F.regexp_replace(F.lower(c), "|".join(BIGRAMS), "")) / n,
        kept(r"(?i)[^aeiou]++"),
        kept(r"[^/]++"),
        kept(r"[^_\-+]++"),
        flag(c.rlike("^(?:eyJ|" + "|".join(x.replace(".", r"\.") for x in BEGINNINGS) + ")")),
        F.greatest(has(left, SECRET_WORDS), flag(left.rlike(KEYED + "[\"']?$"))),
        has(left, PLAIN_WORDS),
        flag(near.rlike(r"[=:]\s*[\"']?$")),
        flag(F.left(after, F.lit(1)).isin('"', "'")),
        flag(near.rlike(r"[/.\\]$") | F.left(after, F.lit(1)).isin("/", ".", "\\") & c.contains("/")),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = SEED, names: tuple[str, ...] = FINDING_WORDS, keys: tuple[str, ...] = KEY_NAMES, known: float = 0.3) -> list[tuple[str, str, str, float]]:
    """(before, candidate, after, label): n findings from a seeded generator, half of them secrets. Things have names of
    these words, and such a share of DICTIONARY's."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: r.choice(DICTIONARY if r.random() < known else names)
    words = lambda k, s: s.join(word() for _ in range(k))
    prose = ("", "the value of ", "see also ", "und die ", "en la ", "of that ", "we set ", "note: ", "avec un ")
    out = []
    for i in range(n):
        lead = r.choice(prose)
        if i % 2:
            kind = r.randrange(8)
            body = (
                lambda: pick(hexa, r.choice((16, 18, 20, 24, 32, 40, 64))),
                lambda: pick(alnum, r.randrange(16, 48)),
                lambda: r.choice(("AKIA", "ASIA")) + pick(string.ascii_uppercase + string.digits, 16),
                lambda: r.choice(("ghp_", "sk-", "glpat-", "xoxb-", "AIza", "sk_live_", "npm_")) + pick(alnum, r.randrange(20, 40)),
                lambda: "eyJ" + pick(alnum, r.randrange(12, 40)) + "." + pick(alnum + "_-", r.randrange(20, 90)) + "." + pick(alnum + "_-", r.randrange(20, 50)),
                lambda: pick(alnum + "+/", r.randrange(24, 64)),
                lambda: pick(hexa, r.choice((18, 32, 40))),
                lambda: pick(string.ascii_letters, r.randrange(20, 48)),
            )[kind]()
            if kind in (2, 3, 4) and r.random() < 0.6 or kind == 7 and r.random() < 0.3:
                out.append((lead, body, r.choice((" ", "", ",", ".")) + "and more", 1.0))
                continue
            key = r.choice(keys)
            key = (key.upper() if r.random() < 0.2 else key) + r.choice(("", "", "_id", "2"))
            sign, quote = r.choice((" = ", "=", ": ", ":", " := ")), r.choice(('"', "'", ""))
            out.append((lead + key + sign + quote, body, quote + r.choice((" ", "\n", ";", " of the")), 1.0))
        else:
            kind = r.randrange(9)
            body, left = (
                lambda: (pick(hexa, r.choice((32, 40, 64))), r.choice(("commit ", "sha1 ", "md5: ", "checksum = ", "etag: ", "revision "))),
                lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), r.choice(("uuid ", "id: ", "guid=", "see "))),
                lambda: (words(3, "/") + str(r.randrange(100)), r.choice(("http://", "file ", "/", "path: "))),
                lambda: (words(2, "_") + "_" + str(r.randrange(10_000)), r.choice(("call ", "the ", "name = ", "def "))),
                lambda: ("".join(word().title() for _ in range(3)) + str(r.randrange(100)), r.choice(("class ", "new ", "in ", "type: "))),
                lambda: (f"2024-0{r.randrange(1, 9)}-{r.randrange(10, 28)}T{r.randrange(10, 23)}", r.choice(("date: ", "at ", "version "))),
                lambda: (words(2, "-") + "-v" + str(r.randrange(9)) + "-" + pick(string.digits, 4), r.choice(("build ", "image ", "page ", "release: "))),
                lambda: (word() + "".join(word().title() for _ in range(r.randrange(2, 4))), r.choice(("call ", "the ", "x = ", "", "import "))),
                lambda: (words(r.randrange(2, 5), "/") + "/" + "".join(word().title() for _ in range(2)), r.choice(("", "in ", "/", "from "))),
            )[kind]()
            out.append((lead + left, body, r.choice((" ", ".", ",", "/", '"')) + "rest", 0.0))
    return out


def keyed_findings(n: int = FINDINGS, seed: int = SEED, names: tuple[str, ...] = FINDING_WORDS, keys: tuple[str, ...] = KEY_NAMES, known: float = 0.3) -> list[tuple[str, str, str, float]]:
    """As labelled_findings, of values assigned to names of secrets: passwords, and words, placeholders and code."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: r.choice(DICTIONARY if r.random() < known else names)
    out = []
    for i in range(n):
        key = r.choice(("", "db_", "my ", "the ")) + r.choice(keys) + r.choice(("", "", "_id", "2"))
        sign = r.choice((" = ", "=", ": ", ":", " := "))
        if i % 2:
            quote = r.choice(('"', '"', "'", ""))
            body = (
                lambda: word() + pick(string.digits, r.randrange(1, 5)) + pick(string.ascii_lowercase + "!&#", r.randrange(3)),
                lambda: word().title() + pick("&!#%*@-", 1) + pick(string.digits, r.randrange(1, 4)) + r.choice(("", "-" + word() + "!")),
                lambda: pick(string.ascii_letters, r.randrange(10, 33)),
                lambda: pick(string.ascii_letters + string.digits, r.randrange(6, 16)),
                lambda: pick(string.ascii_letters + string.digits + "!&#%*@-$^.", r.randrange(8, 24)),
                lambda: "".join(word() for _ in range(r.randrange(3, 6))),
                lambda: ".".join(pick("0123456789abcdef", 4) for _ in range(r.randrange(2, 5))),
                lambda: word().title().replace("o", "0").replace("a", "4").replace("i", "1").replace("s", "5") + r.choice(("!", "#", "", "?")) + pick(string.digits, 1),
            )[r.randrange(8)]()
            out.append((key + sign + quote, body, quote + r.choice((" ", "\n", " and"))[: 3 if quote else 1], 1.0))
        else:
            body, quote = (
                lambda: (pick(string.ascii_lowercase, r.randrange(1, 10)), ""),
                lambda: (word(), ""),
                lambda: (r.choice(("None", "null", "true", "false", "True", "False", "str", "string", "nil", "required", "optional", "Option", "basic", "Bearer", "changed", "expired")), ""),
                lambda: (r.choice(("os.environ[", "get_", "config.", "self.", "$", "<your-", "{{")) + word() + r.choice(("", ")", "()", "_name")), ""),
            )[r.randrange(4)]()
            out.append((key + sign + quote, body, quote + r.choice((" ", "\n", ",")), 0.0))
    return out


def featured(findings: DataFrame) -> DataFrame:
    """FEATURES of (before, c, after), with the label where there is one."""
    label = ["label"] if "label" in findings.columns else []
    return findings.select(*label, *(x.cast("double").alias(k) for k, x in zip(FEATURES, features(F.col("c"), F.col("before"), F.col("after")), strict=True)))


def fit(spark: SparkSession, findings: list[tuple[str, str, str, float]] | None = None):
    """The forest as Spark ML has it, of columns FEATURES gathered in ``features``."""
    rows = spark.createDataFrame(findings if findings is not None else [*labelled_findings(), *keyed_findings()], "before string, c string, after string, label double")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured(rows).coalesce(1))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(vectors)


def as_sql(model) -> str:
    """A forest as SQL over a struct f of FEATURES: the mean of the trees' shares of secrets."""

    def sql(node) -> str:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return repr(stats[1] / sum(stats)) + "D"
        split = node.split()
        return f"if(f.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D, {sql(node.leftChild())}, {sql(node.rightChild())})"

    return "(" + " + ".join(sql(t._call_java("rootNode")) for t in model.trees) + f") / {len(model.trees)}"


def train(spark: SparkSession, findings: list[tuple[str, str, str, float]] | None = None) -> str:
    return as_sql(fit(spark, findings))


def _scanned(docs: DataFrame, text_col: str, forest: str, threshold: float, names: tuple[str, str, str]) -> DataFrame:
    """docs with columns of these names for candidates, secrets and the redacted text; docs has none of them."""
    own = "_s"
    while any(c.lower().startswith(own) for c in docs.columns):  # a beginning that no column of docs has
        own += "_"
    text = F.col(f"`{text_col}`")
    keyed, found, parts, near, f, p = (f"{own}{x}" for x in ("keyed", "found", "parts", "near", "f", "p"))
    held = docs.withColumn(keyed, text.rlike(KEYED))
    held = held.withColumn(found, F.when(F.col(keyed), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(LONG), F.lit(0))))
    held = held.withColumn(parts, F.when(F.size(found) > 0, F.when(F.col(keyed), F.split(text, CANDIDATE, -1)).otherwise(F.split(text, LONG, -1))))
    # the text before a candidate, others in it; each part but the first follows a candidate of a code point or more
    ends = lambda x: F.right(x, F.lit(BESIDE))
    before = lambda i: F.transform(F.sequence(F.greatest(i - BESIDE, F.lit(0)), i), lambda j: F.concat(ends(F.get(parts, j)), F.when(j < i, ends(F.get(found, j))).otherwise("")))
    held = held.withColumn(near, F.when(F.size(found) > 0, F.transform(found, lambda c, i: F.struct(c.alias("c"), ends(F.array_join(before(i), "")).alias("before"), F.get(parts, i + 1).alias("after")))))
    looked = F.transform(near, lambda x: F.struct(*(y.cast("double").alias(k) for k, y in zip(FEATURES, features(x["c"], x["before"], x["after"]), strict=True))))
    held = held.withColumn(f, F.when(F.size(found) > 0, looked)).withColumn(p, F.expr(f"transform({f}, f -> {forest})"))
    pieces = F.transform(parts, lambda part, i: F.concat(part, F.when(F.get(p, i) >= threshold, F.lit(MASK)).otherwise(F.coalesce(F.get(found, i), F.lit("")))))
    candidates, secrets, redacted = names
    out = held.withColumn(candidates, F.when(F.col(found).isNull(), 0).otherwise(F.size(found)).cast("long"))
    out = out.withColumn(secrets, F.when(F.col(p).isNull(), 0).otherwise(F.size(F.filter(p, lambda x: x >= threshold))).cast("long"))
    out = out.withColumn(redacted, F.when(F.col(secrets) > 0, F.array_join(pieces, "")).otherwise(text))
    return out.drop(keyed, found, parts, near, f, p)


ADDED = ("n_candidates", "n_secrets", "redacted")


def scan(docs: DataFrame, text_col: str = "text", *, forest: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_candidates, n_secrets and redacted: the text with MASK for every secret.

    A null text has no candidates and stays null. Texts without candidates are
    unchanged. Where docs has a column of one of these names, it stays and the
    new one has ``secret_`` before its name.
    """
    taken = {c.lower() for c in docs.columns}
    name = lambda c: name(f"secret_{c}") if c in taken else c
    return _scanned(docs, text_col, forest or train(docs.sparkSession), threshold, tuple(map(name, ADDED)))


def findings(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, redacted_sha256), a row per row of docs.

    A null text has no candidates and a null digest; an empty one the digest of nothing. Rows of repeated and of null
    ids are looked at each for itself, whole texts however long; other columns of docs aren't looked at. An empty table
    gives an empty table.
    """
    scanned = scan(docs.select("doc_id", "text"), **options)
    return scanned.select("doc_id", "n_candidates", "n_secrets", F.sha2("redacted", 256).alias("redacted_sha256"))


def redact(docs: DataFrame, *, forest: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with secrets masked in text, and no other columns than docs has; n_chars, where docs has it, follows the text."""
    own = "_r"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    out = _scanned(docs, "text", forest or train(docs.sparkSession), threshold, (f"{own}c", f"{own}n", f"{own}t")).withColumn("text", F.col(f"{own}t"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"{own}n") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
