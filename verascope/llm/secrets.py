"""Secret scans from built-in functions only: patterns find candidates, a random forest removes false positives.

Everything about a document happens in its row: candidates and the text between them are cut by one pattern, so
neighbouring words need no positions; features are string expressions; the trained trees are walked by expressions too.
No rows are shuffled. The forest is trained on labelled findings: rows (before, value, after, label) of the caller,
or the built-in ones, which a rule makes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEYS = "password|passwd|passphrase|passcode|(?<![A-Za-z])pass|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key"
#: A private key block, its end line lost or not; a quoted value of several words, or any value up to white space or a quote,
#: less the punctuation at its end, assigned to a telling name; what such a name is said to be; a password in a URL; a long run
#: with a digit.
#: Short lookbehinds come first and spare most places the long ones.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,24}PRIVATE KEY-----|\z)|(?:\s{1,4}[A-Za-z0-9+/=]{16,}+)++)"
    rf"|(?<=[:=][\"' ]{{0,2}})(?<=(?i:{_KEYS})[\"' ]{{0,2}}[:=][\"' ]{{0,2}})"
    r"(?:(?<=[:=] ?\")[^\s\"]{1,40}(?: [^\s\"]{1,40}){1,9}(?=\")|(?<=[:=] ?')[^\s']{1,40}(?: [^\s']{1,40}){1,9}(?=')|[^\s\"']{3,}[^\s\"',;.])"
    rf"|(?<= is [\"']?)(?<=(?i:{_KEYS}) is [\"']?)[^\s\"']{{6,}}[^\s\"',;.]"
    r"|(?<=:)(?<=://[^\s/:@]{1,64}:)[^\s/@\"']++(?=@)"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]{16})[A-Za-z_+/-]*+[0-9][A-Za-z0-9_+/-]*+={0,2}"
)
#: Words that identifiers, paths and placeholders are made of.
DICTIONARY = (
    "access account action admin api app application article async auth backup base block body build button cache change check class client cloud code color column "
    "commit common config content context control core count create custom data date default delete demo device digest document domain element error event example export "
    "feature field file filter folder format function group guide handler hash head header home html http image import index info input instance integration item java json "
    "key label language layout level library license link linux list local login main manager master message method model module name network node number object option order "
    "output package page param password path payment photo plugin position post private process product profile project property public query release report request resource "
    "response result review rule schema script search section secret select server service session setting sha site source start state static status storage story string style "
    "system table target task template test text theme thread time title token total type union update upload user util value version video view web widget window word work your"
).split()
#: Passwords that are chosen most often, less those that are digits only.
WEAK = (
    "qwerty password letmein dragon iloveyou monkey abc123 football baseball welcome shadow sunshine master princess qwertyuiop trustno1 superman qazwsx michael ninja mustang access "
    "batman starwars passw0rd hunter2 charlie donald jordan harley ranger thomas robert soccer hockey killer george andrew tigger pepper ginger cheese summer winter secret1 admin123 root123 changeme1 whatever computer"
).split()
#: Words of sentences about passwords.
PROSE = "the a an your must be is not at least please enter of this and with for to in or if it should can has have only when will".split()
FEATURES = ("length", "class_changes", "vowel_changes", "distinct", "digits", "upper", "letters_only_hex", "dictionary", "repeated", "parts", "path_before", "path_after", "key_word", "plain_word", "known_prefix", "url_login", "assigned", "words", "weak", "code", "prose")


def features(before: Column, value: Column, after: Column) -> list[Column]:
    """The FEATURES of a candidate, as doubles."""
    size = F.length(value).cast("double")
    lower = F.lower(value)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    vowels = F.regexp_replace(F.regexp_replace(lower, "[aeiou]", "0"), "[b-df-hj-np-tv-z]", "b")
    runs = lambda s: F.length(F.regexp_replace(s, r"(.)\1+", "$1")).cast("double") / size
    share = lambda pattern: (size - F.length(F.regexp_replace(value, pattern, ""))) / size
    near, word = F.substring(before, -40, 40), F.regexp_extract(F.substring(before, -200, 200), r"\S*$", 0)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        size,
        runs(classes),
        runs(vowels),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(40.0)),
        share("[0-9]+"),
        share("[A-Z]+"),
        flag(value.rlike("^[0-9a-f]+$")),
        (size - F.length(F.regexp_replace(lower, "(?:" + "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True)) + ")", ""))) / size,
        F.lit(1.0) - F.length(F.regexp_replace(value, r"(.)\1{2,}", "$1")) / size,
        F.size(F.split(value, "[_/-]")).cast("double"),
        flag(word.rlike(r"[/@.:\\?&][^\"'=]*$") & ~word.rlike(r"[:=][\"']?$")),
        flag(after.rlike(r"^(?:@|/|\.[A-Za-z]|:\d)")),
        flag(near.rlike(rf"(?i)(?:{_KEYS})[\"']?(?: is)?\s*[:=]?\s*[\"']?$")),
        flag(near.rlike(r"(?i)\b(?:commit|revision|checksum|md5|sha\d*|digest|hash|uuid|guid|etag|build|version|isbn|invoice|order|phone|card|serial|integrity|id)\W{0,3}$")),
        flag(value.rlike(r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ|SG\.|-----BEGIN)")),
        flag(word.rlike("://[^/:@]{1,64}:$") & after.startswith("@")),
        # by a sign without a blank, or between quotes: as programs and settings do it
        flag(near.rlike(r"(?:=|[:=] ?[\"'])$")),
        size - F.length(F.regexp_replace(value, " ", "")),
        flag(lower.isin(WEAK)),
        # a call, a placeholder, a path of names
        flag(value.rlike(r"^[$%<{\[]|[(\[{][^)\]}]*[)\]}]?$|^[A-Za-z_]+(?:(?:\.|::|->)[A-Za-z_]+)+$")),
        (size - F.length(F.regexp_replace(lower, rf"\b(?:{'|'.join(PROSE)})\b", ""))) / size,
    ]


def built_in_findings(spark: SparkSession, n: int = 5000) -> DataFrame:
    """(before, value, after, label): findings of the common true and false kinds, made from digests of their number."""
    d = spark.range(n).select("id", F.sha2(F.concat(F.lit("a"), F.col("id")), 256).alias("h"), F.sha2(F.concat(F.lit("b"), F.col("id")), 256).alias("g"))
    mixed = F.translate(F.base64(F.unhex("h")), "+/=", "xYz")
    # one literal for a list of words: an expression for each makes plans that take the driver's memory and time
    pick = lambda words, salt: F.element_at(F.split(F.lit("\x1f".join(words)), "\x1f"), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    plain = pick(("the ", "of this and ", "see ", "with on ", "a\n", "", "for it, "), 1)
    keyed = F.concat(pick(("password", "token", "secret", "api_key", "apikey", "auth", "access_key", "PASSWORD", "Token"), 2), pick(("=", " = ", ": ", '="', ' = "', ":'"), 3))
    named = F.concat(pick(("commit ", "checksum ", "sha256: ", "md5 ", "uuid ", "build ", "etag: ", "revision ", "digest "), 4))
    word = lambda salt: pick(DICTIONARY, salt)
    cut = lambda c, lo, spread: F.substring(c, F.lit(1), (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(spread)) + lo).cast("int"))
    digits = F.substring(F.translate("h", "abcdef", "012345"), 1, 16)
    slug = F.concat_ws("-", word(6), word(7), word(8), F.substring(digits, 1, 4))
    symbol = lambda salt: pick(("!", "@", "#", "$", "&", "%", "*", "^"), salt)
    login = F.concat(plain, pick(("https://", "postgres://", "mysql://", "amqp://", "ftp://"), 31), word(32), F.lit(":"))
    # letters as digests give them: like no word that programs are made of
    letters = F.translate("h", "0123456789abcdef", "etaoinshrdlucmwy")
    assigned = F.concat(pick(("password", "passwd", "pwd", "DB_PASS", "secret", "pass", "passphrase", "PASSWORD", "token", "auth"), 34), pick(("=", '="', "='", ' = "', ': "', ":'"), 35))
    opened = F.concat(pick(("password", "passwd", "passphrase", "secret", "pwd"), 36), pick(('="', ' = "', ': "'), 37))
    said = F.concat(plain, pick(("password is ", "Password is ", "token is ", "passphrase is ", "secret is ", "pwd is "), 38))
    common = lambda salt: pick(PROSE, salt)
    kinds = [
        (assigned, cut(letters, 5, 12), 1),
        (assigned, F.concat(cut(letters, 4, 8), F.substring(digits, 1, 1)), 1),
        (assigned, F.concat(cut(letters, 3, 7), F.substring(digits, 1, 4)), 1),
        (opened, F.concat_ws(" ", word(39), word(40), F.concat(F.substring(letters, 1, 5), F.substring(digits, 1, 1))), 1),
        (opened, F.concat_ws(" ", F.substring(letters, 1, 6), word(41), F.substring(letters, 8, 4), F.substring(letters, 14, 5)), 1),
        (opened, F.concat_ws(" ", F.substring(letters, 2, 3), F.substring(letters, 6, 5), F.concat(word(70), F.substring(digits, 1, 1))), 1),
        (opened, F.concat_ws(" ", word(71), F.substring(letters, 3, 4), word(72), F.substring(digits, 2, 2)), 1),
        (said, cut(mixed, 9, 12), 1),
        (said, F.concat(F.initcap(F.translate(word(42), "aeo", "430")), symbol(43), F.substring(digits, 1, 3)), 1),
        (opened, F.concat_ws(" ", common(44), word(45), common(46), common(47), word(48)), 0),
        (opened, F.concat_ws(" ", common(49), common(50), word(51)), 0),
        (opened, F.concat_ws(" ", common(61), common(62), F.substring(digits, 1, 1), word(63)), 0),
        (opened, F.concat_ws(" ", common(64), common(65), common(66), F.substring(digits, 1, 2), word(67)), 0),
        (assigned, pick(WEAK, 68), 1),
        (assigned, pick(WEAK, 69), 1),
        (said, F.concat(word(52), word(53)), 0),
        (said, cut(letters, 7, 8), 0),
        (said, pick(("required", "incorrect", "invalid", "missing", "expired", "optional", "wrong,", "correct", "encrypted", "changed"), 54), 0),
        (assigned, F.concat(word(55), pick(("(", "()", ".get(", "[", "_", "."), 56), word(57), pick((")", "]", "", "()"), 58)), 0),
        (assigned, F.concat(word(59), word(60)), 0),
        (assigned, F.concat(word(73), F.lit("."), word(74)), 0),
        (assigned, F.concat(pick(("get", "set", "read", "load", "new", "make"), 75), F.initcap(word(76)), F.lit("()")), 0),
        (assigned, F.concat(F.lit("${"), F.upper(F.concat_ws("_", word(77), word(78))), F.lit("}")), 0),
        (assigned, F.concat(pick(("self.", "this.", "os.", "env.", "args.", "ctx->", "req::"), 79), F.concat_ws("_", word(80), word(81))), 0),
        (keyed, F.substring("h", 1, 40), 1),
        (keyed, cut(F.col("h"), 12, 36), 1),
        (keyed, cut(mixed, 14, 28), 1),
        (plain, F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(mixed, 1, 16), "abcdef", "ABCDEF"))), 1),
        (plain, F.concat(pick(("ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "AIza", "eyJ"), 9), F.substring(mixed, 3, 30)), 1),
        (keyed, F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(mixed, 5, 16), "abcdef", "ABCDEF"))), 1),
        (keyed, F.concat(F.substring(mixed, 1, 3), symbol(18), F.substring(mixed, 5, 5), symbol(19), F.substring(digits, 1, 4)), 1),
        (keyed, F.concat(F.initcap(F.translate(word(20), "aeo", "430")), symbol(21), F.substring(digits, 1, 4)), 1),
        (keyed, F.concat(F.initcap(F.translate(word(22), "aeo", "430")), symbol(23), F.substring(mixed, 7, 3)), 1),
        (keyed, F.concat(cut(mixed, 3, 5), F.substring(digits, 1, 1), F.substring(mixed, 9, 1)), 1),
        (login, cut(mixed, 5, 9), 1),
        (login, F.concat(word(24), symbol(25), F.substring(digits, 1, 3)), 1),
        (keyed, pick(("null", "None", "true", "false", "required", "string", "<password>", "${PASSWORD}", "********", "<your-token>", "{{token}}", "xxxxxx", "changeme", "str"), 26), 0),
        (keyed, word(27), 0),
        (keyed, pick(("None", "null", "True", "False", "required", "string", "undefined", "empty", "Optional", "here", "that", "must", "This"), 33), 0),
        (keyed, F.concat(word(28), F.lit("."), word(29), pick(("()", "[0]", "", ")"), 30)), 0),
        (named, F.substring("h", 1, 40), 0),
        (named, cut(F.col("g"), 20, 44), 0),
        (plain, digits, 0),
        (plain, cut(F.translate("g", "abcdef", "678901"), 16, 8), 0),
        (plain, slug, 0),
        (F.concat(plain, F.lit("https://site.example/"), word(10), F.lit("/")), slug, 0),
        (F.concat(plain, F.lit("/usr/lib/")), F.concat(word(11), F.lit("/"), word(12), F.lit("64/"), word(13), F.lit("2")), 0),
        (keyed, F.concat(word(14), F.lit("_"), word(15)), 0),
        (keyed, pick(("xxxxxxxxxxxxxxxx", "00000000000000000000", "your-token-here", "EXAMPLEKEY000000", "changeme-changeme", "placeholder_value_1"), 16), 0),
        (plain, F.concat(F.substring("g", 1, 8), F.lit("-"), F.substring("g", 9, 4), F.lit("-"), F.substring("g", 13, 4), F.lit("-"), F.substring("g", 17, 4), F.lit("-"), F.substring("g", 21, 12)), 0),
    ]
    ends = pick((" and", ".", '"', "\n", "&&& of", ", "), 17)
    parts = []
    # a few kinds at a time: all at once are more than one compiled method can hold
    for first in range(0, len(kinds), 8):
        value, before, label, after = [F.when(F.lit(False), None)] * 4
        for k, (b, v, y) in enumerate(kinds[first : first + 8], first):
            here = F.col("id") % len(kinds) == k
            value, before, label, after = value.when(here, v), before.when(here, b), label.when(here, F.lit(float(y))), after.when(here, F.lit("@db.example/") if b is login else ends)
        mine = d.where((F.col("id") % len(kinds)).between(first, first + 7))
        parts.append(mine.select(before.alias("before"), value.alias("value"), after.alias("after"), label.alias("label")))
    return reduce(DataFrame.unionByName, parts)


Tree = tuple | float


def _tree(node) -> Tree:
    """(feature, threshold, left, right), or the share of true findings in a leaf."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return stats[1] / max(sum(stats), 1e-9)
    split = node.split()
    return (split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild()))


def train(findings: DataFrame, trees: int = 20, depth: int = 6, max_rows: int = 20_000) -> list[Tree]:
    """A random forest on labelled findings (before, value, after, label), at most about max_rows of them by hash."""
    rows = _vectors(findings, max_rows).cache()
    try:
        return [_tree(t.rootNode()) for t in _fit(rows, trees, depth)._java_obj.trees()]
    finally:
        rows.unpersist()


def _vectors(findings: DataFrame, max_rows: int) -> DataFrame:
    """(label, x) of findings, at most about max_rows of them by hash."""
    total = findings.count()
    if total > max_rows:
        findings = findings.where(F.pmod(F.xxhash64("before", "value"), F.lit(total)) < max_rows)
    columns = [c.alias(name) for name, c in zip(FEATURES, features(F.col("before"), F.col("value"), F.col("after")), strict=True)]
    return VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(findings.select("label", *columns)).select("label", "x").coalesce(1)


def _fit(rows: DataFrame, trees: int, depth: int):
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=5).fit(rows)


def _flat(forest: list[Tree]) -> tuple[list[int], list[tuple[int, float, int, int, float]], int]:
    """Roots, the nodes (feature, threshold, left, right, share) of all trees by number, and the greatest depth.

    A leaf is followed by itself.
    """
    nodes: list[tuple[int, float, int, int, float]] = []

    def add(tree: Tree) -> tuple[int, int]:
        at = len(nodes)
        if not isinstance(tree, tuple):
            nodes.append((0, 0.0, at, at, float(tree)))
            return at, 0
        nodes.append(())
        (left, one), (right, two) = add(tree[2]), add(tree[3])
        nodes[at] = (tree[0], float(tree[1]), left, right, 0.0)
        return at, 1 + max(one, two)

    added = [add(t) for t in forest]
    return [at for at, _ in added], nodes, max(depth for _, depth in added)


def _probability(forest: list[Tree], x: Column) -> Column:
    """The mean share of the leaves that an array of FEATURES comes to.

    The trees are walked in arrays of constants, each one literal. An expression for each of their nodes makes a plan whose
    analysis takes hundreds of MB of the driver.
    """
    roots, nodes, depth = _flat(forest)
    constants = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
    feature, threshold, left, right, share = (constants(v, k) for v, k in zip(zip(*nodes, strict=True), ("int", "double", "int", "int", "double"), strict=True))
    step = lambda at, _: F.when(F.get(x, F.get(feature, at)) <= F.get(threshold, at), F.get(left, at)).otherwise(F.get(right, at))
    leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, step) if depth else root
    return F.aggregate(constants(roots, "int"), F.lit(0.0), lambda total, root: total + F.get(share, leaf(root))) / len(forest)


def _score(tree: Tree, x: Column) -> Column:
    """The share of the leaf that a struct of FEATURES comes to."""
    return _probability([tree], F.array(*[x[name] for name in FEATURES]))


def scan(df: DataFrame, forest: list[Tree], text_col: str = "text") -> DataFrame:
    """(row, between, found): the whole row of df as a struct, the texts around its candidates (one more than those), and
    array<struct<nth, value, before, p>> of the candidates.

    between[0], found[0].value, between[1], ... joined give the text. Null and empty texts have no candidate.
    """
    df = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("values", F.when(F.col("text").rlike("[0-9:=-]| is "), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("between", F.when(F.size("values") > 0, F.split("text", CANDIDATE, -1)).otherwise(F.array("text")))

    def judge(value: Column, i: Column) -> Column:
        before, after = F.get("between", i), F.get("between", i + 1)
        # the features are worked out once: as elements of an array they are bound to a variable
        p = F.transform(F.array(F.array(*features(before, value, after))), lambda x: _probability(forest, x))[0]
        return F.struct(i.alias("nth"), value.alias("value"), F.substring(before, -40, 40).alias("before"), p.alias("p"))

    return df.select("row", "between", F.transform("values", judge).alias("found"))


def kind(value: Column, before: Column) -> Column:
    return (
        F.when(value.rlike("^(?:AKIA|ASIA)"), "cloud_access_key")
        .when(value.startswith("-----BEGIN"), "private_key")
        .when(value.rlike("^(?:ghp_|gho_|github_pat_|glpat-|xox|sk_live_|rk_live_|AIza|eyJ)"), "service_token")
        .when(before.rlike(r"://[^\s/:@]{1,64}:$"), "password")
        .when(before.rlike(r"(?i)pass\w*[\"' ]{0,2}[:=][\"' ]{0,2}$"), "password")
        .when(before.rlike(rf"(?i)(?:{_KEYS})[\"' ]{{0,2}}[:=][\"' ]{{0,2}}$"), "assigned_secret")
        .otherwise("random_value")
    )


def findings(df: DataFrame, forest: list[Tree], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, nth, kind, value_sha256, n_chars, probability): a row per candidate that the forest calls a secret.

    nth counts the text's candidates from 0; the value itself is not returned. Null, empty and clean texts give no row; rows
    that repeat a doc_id give theirs each, a null doc_id too; a value that occurs twice in a text gives two rows. A
    probability at the threshold counts. Texts may have any length. Other columns are not read, so their names may clash.
    An empty table gives none.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    x = scan(source, forest).select("row.doc_id", F.explode(F.filter("found", lambda f: f["p"] >= threshold)).alias("f"))
    return x.select(
        "doc_id",
        F.col("f.nth").cast("long").alias("nth"),
        kind(F.col("f.value"), F.col("f.before")).alias("kind"),
        F.sha2("f.value", 256).alias("value_sha256"),
        F.length("f.value").cast("long").alias("n_chars"),
        F.col("f.p").alias("probability"),
    )


def redacted(df: DataFrame, forest: list[Tree], text_col: str = "text", length_col: str | None = None, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """df with every secret in text_col replaced by the mark; all rows and columns stay, null and clean texts as they are.

    length_col, if given, changes by as many characters as the text does. Columns may have any name; repeated rows stay.
    """
    pieces = F.zip_with("between", "found", lambda b, f: F.concat(b, F.when(f.isNull(), "").when(f["p"] >= threshold, mark).otherwise(f["value"])))
    row = lambda name: F.col("row").getField(name)
    marked = F.exists("found", lambda f: f["p"] >= threshold)
    new = {text_col: F.when(marked, F.array_join(pieces, "")).otherwise(row(text_col))}
    if length_col:
        grown = F.aggregate("found", F.lit(0), lambda n, f: n + F.when(f["p"] >= threshold, len(mark) - F.length(f["value"])).otherwise(0))
        new[length_col] = (row(length_col) + grown).cast(df.schema[length_col].dataType)
    return scan(df, forest, text_col).select(*[new.get(c, row(c)).alias(c) for c in df.columns])
