"""Secret scans: candidates by one pattern, false positives removed by a random forest.

A candidate is what is assigned to a name such as password, api_key or secretKey (4 characters or more,
up to white space, a quote, a bracket or one of , ; &), a run of at least 16 letters, digits
and _ + / - that holds a digit, with up to two = after it, or a block of a private key. Its features are its length, its character transitions and classes, the
share of it that dictionary words cover, signs of a path, and the words around it. A random
forest, trained from labelled findings, votes; a candidate with at least half of the votes
is a secret. The trained trees are written out as one SQL expression, so scoring stays in
the row: no shuffle, no Python, whole texts.

The labelled findings may be given (columns text and label: one candidate in each text). By
default they are drawn up from a table of formats, as many as FINDINGS: keys, tokens,
passwords, short ones and passphrases too, on the one side; hashes, identifiers, numbers,
paths, links, names, ordinary words and placeholders on the other.

Defined cases: null and empty texts have no candidates and stay as they are; a long text is
scanned whole; repeated rows give equal findings; other columns are kept.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh

_ASSIGNED = "(passw|passwd|pwd|secret|token|api.?key|apikey|access.?key|auth|bearer|credential|private)"
_VALUE = r"[^\s\x22\x27<>,;&()\[\]{}]"
_BLOCK = r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?"
_GIVEN = r"(?<=[=: \x22\x27])(?<=[=:] {0,2}[\x22\x27]?)(?<=(?i:" + _ASSIGNED.replace("(", "(?:") + r")(?i:ord|ort)?(?i:s)?(?:[A-Z_-][A-Za-z_-]{0,15})?[\x22\x27]? {0,2}[=:] {0,2}[\x22\x27]?)(?!-----)" + _VALUE + r"{3,}(?![.:?])" + _VALUE
_RUN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}={0,2}"
CANDIDATE = f"{_BLOCK}|{_GIVEN}|{_RUN}"

#: Characters looked at before and after a candidate.
BEFORE, AFTER = 48, 24

FINDINGS, TREES, DEPTH, SEED = 6_000, 25, 6, 5
MASK = "[SECRET]"

#: Dictionary for the coverage feature: words that names, paths and placeholders are made of (fixed values).
DICTIONARY = (
    "about access account action admin after album alpha api app archive article asset audio author auto backup base beta blog board book branch bucket build cache case change chapter check class client clip code color comment "
    "common config content core count create custom data date default delete demo detail dev direct dist doc docs document download draft edit email end entry error event example export feature feed field file filter final find first "
    "font form forum free front full gallery game get group guide head help here history home host html image img import index info input insert item job key lang last layer level lib library license line link list live load local "
    "lock log login mail main map market media menu message method mode model module month music name network new news next node note number object offer old open option order output package page part password path people photo "
    "place plan play plugin point pool post press preview price print process product profile project public query quick random read record release remote report request reset resource result review root route row rule sale sample "
    "save school score screen script search section secret select server service session set shop show single site size small snapshot some sort source space sport stage start state static status step stock store story stream string "
    "style suite support system table tag target team temp template term test text theme thread time title token tool topic total track train travel type update upload url user usr utils value version video view visual week widget "
    "window word work world year your"
).split()

#: What stands after a name in ordinary text (fixed values).
STATES = "required enabled disabled missing invalid expired forgotten unknown optional hidden accepted refused pending renewed granted withheld".split()

_WORDS = "|".join(sorted(DICTIONARY, key=len, reverse=True))
_HASHED = "(commit|sha|md5|hash|checksum|digest|revision|etag|integrity|uuid|isbn|card|phone|order|invoice|number)"

#: name -> SQL over c (candidate), b (lower-cased text before it), a (lower-cased text after it).
FEATURES = {
    "length": "length(c)",
    "transitions": r"length(regexp_replace(c, '[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+', 'x')) / length(c)",
    "digits": "length(regexp_replace(c, '[^0-9]+', '')) / length(c)",
    "upper": "length(regexp_replace(c, '[^A-Z]+', '')) / length(c)",
    "hexadecimal": "if(c rlike '^[0-9a-f]+$' or c rlike '^[0-9A-F]+$', 1, 0)",
    "variety": "size(array_distinct(split(c, ''))) / length(c)",
    "dictionary": f"1 - length(regexp_replace(lower(c), '{_WORDS}', '')) / length(c)",
    "separators": r"length(regexp_replace(c, '[^_/-]+', '')) / length(c)",
    "path": r"if(b rlike '[./~:\\\\-]$' or b rlike '(https?:|www[.]|file:)[^ ]*$', 1, 0) + if(a rlike '^([/.][a-z0-9]|[?#&])', 1, 0)",
    "slashes": "length(regexp_replace(c, '[^/]+', ''))",
    "named": f"if(b rlike '{_ASSIGNED}[^ ]{{0,16}}[ =:]{{0,4}}[^a-z0-9]{{0,3}}$', 1, 0)",
    "assigned": r"if(b rlike '[=:] {0,2}[^a-z0-9 ]{0,2}$', 1, 0)",
    "counted": f"if(b rlike '{_HASHED}[^ ]{{0,12}}[ =:#]{{0,4}}[^a-z0-9]{{0,2}}$', 1, 0)",
    "provider": "if(c rlike '^(AKIA|ASIA)[0-9A-Z]{16}$' or c rlike '^(ghp|gho|ghs|xoxb|xoxp|sk|pk|rk|glpat)[_-]' or c rlike '^-----BEGIN', 1, 0)",
    "placeholder": "if(lower(c) rlike '(x{4}|0{5}|1234|abcd|example|placeholder|changeme|your)', 1, 0)",
}


def _candidates(text: str) -> str:
    """SQL array of the candidates of a text: at (from 0), c, b and a."""
    pattern = "'" + CANDIDATE.replace("\\", "\\\\") + "'"
    parts = f"split({text}, {pattern}, -1)"
    found = f"regexp_extract_all({text}, {pattern}, 0)"
    sized = "transform(m.c, (x, i) -> length(m.p[i]) + if(i > 0, length(m.c[i - 1]), 0))"
    sums = f"aggregate({sized}, cast(array() as array<int>), (acc, x) -> concat(acc, array(x + if(size(acc) > 0, acc[size(acc) - 1], 0))))"
    rows = f"transform(m.c, (x, i) -> struct(at[i] as at, x as c, lower(right(m.p[i], {BEFORE})) as b, lower(left(m.p[i + 1], {AFTER})) as a))"
    return f"transform(array(struct({parts} as p, {found} as c)), m -> transform(array({sums}), at -> {rows})[0])[0]"


def _features(name: str) -> str:
    """SQL struct of the features of a candidate struct variable."""
    inner = "struct(" + ", ".join(f"cast({sql} as double) as {k}" for k, sql in FEATURES.items()) + ")"
    return f"transform(array({name}.c), c -> transform(array({name}.b), b -> transform(array({name}.a), a -> {inner})[0])[0])[0]"


def _texts(spark: SparkSession, n: int) -> DataFrame:
    """Labelled findings by formats: text and label."""
    d = "sha2(concat('finding', id), 256)"
    hexa = lambda k, at=1: f"substr({d}, {at}, {k})"
    upper = f"translate({hexa(16, 9)}, '0123456789abcdef', '3A7CZEQGH2JKWMN5')"
    mixed = lambda k: f"translate(substr(base64(unhex({d})), 1, {k}), '+/', 'xQ')"
    word = lambda k: f"element_at(split('{' '.join(DICTIONARY)}', ' '), 1 + cast(conv(substr({d}, {20 + 3 * k}, 3), 16, 10) as int) % {len(DICTIONARY)})"
    digits = lambda k: f"rpad(conv(substr({d}, 1, 14), 16, 10), {k}, '4815162342')"
    names = lambda sep, k, number=True: f"concat_ws('{sep}', {', '.join(word(j) for j in range(k))}{', cast(id % 97 as string)' if number else ''})"
    letters = lambda k: f"translate({hexa(k, 7)}, '0123456789abcdef', 'qxzKvWjytPbdRfgh')"
    state = f"element_at(split('{' '.join(STATES)}', ' '), 1 + cast(conv(substr({d}, 41, 3), 16, 10) as int) % {len(STATES)})"
    secrets = [
        f"concat('password=', {hexa(18)})", f"concat('token = \"', {hexa(40)}, '\"')", f"concat('AKIA', {upper})", f"concat('secret_key: ', {mixed(40)})", f"concat('api_key=', {hexa(32)})",
        f"concat('ghp_', {mixed(36)})", f"concat('Authorization: Bearer ', {mixed(32)})", f"concat('aws_secret_access_key = ', {mixed(40)})", f"concat('\"password\": \"', {mixed(20)}, '\"')", f"concat('sk_live_', {mixed(24)})",
        f"concat('password: ', {mixed(9)})", f"concat('pwd=', {word(1)}, '!', {hexa(4)})", f"concat('passwd = ', {names('-', 4, False)})", f"concat('password = ', {word(1)}, '-', {letters(6)}, '-', {word(2)}, '-', {word(3)})", f"concat('\"secret\": \"', {letters(12)}, '\"')", f"concat('token: ', {mixed(12)}, '#')",
        f"concat('-----BEGIN RSA PRIVATE KEY-----', char(10), {mixed(40)}, char(10), '-----END RSA PRIVATE KEY-----')",
    ]
    others = [
        digits(16), f"concat('commit ', {hexa(40)})", f"concat('https://www.', {word(1)}, '.example.com/', {names('-', 4)})", f"concat('/usr/share/', {names('/', 4)})", f"concat('id ', {hexa(8)}, '-', {hexa(4, 9)}, '-', {hexa(4, 13)}, '-', {hexa(12, 17)})",
        f"concat('password=', {word(1)}, '-password-', {word(2)}, '-1234')", f"concat('token = \"your_token_', {word(1)}, '_goes_here_0\"')", names("_", 4), f"concat('sha256: ', {d})", f"concat('card number ', {digits(16)})",
        f"concat('release-2024-05-01-', {word(1)}, '-build-', id % 97)", f"concat('md5 ', {hexa(32)})", f"concat('order ', {digits(20)})", f"concat({word(1)}, {word(2)}, {word(3)}, {word(4)}, id % 9)", f"concat('see ', {names('-', 5)}, '.html')",
        f"concat('https://', {word(1)}, '.example.org/en/', {digits(18)}, '?page=2')",
        f"concat('password: ', {word(1)})", f"concat('token: ', {state})", f"concat('secret: ', initcap({word(1)}), ' ', initcap({word(2)}))", f"concat('Password: ', initcap({state}))", f"concat('tokens: ', 1900 + id % 120)",
        f"concat('password = ', {names('_', 2, False)}, '()')", f"concat('token=$', upper({word(1)}))", f"concat('auth: https://www.', {word(1)}, '.example.com/', {word(2)})", f"concat('auth: ', {word(1)}, id % 9)",
    ]
    pick = lambda options: "CASE " + " ".join(f"WHEN id div 2 % {len(options)} = {i} THEN {x}" for i, x in enumerate(options)) + " END"
    text = f"concat_ws(' ', {word(5)}, {word(6)}, {word(7)}, CASE WHEN id % 2 = 1 THEN {pick(secrets)} ELSE {pick(others)} END, {word(8)}, {word(9)})"
    return spark.range(n).selectExpr(f"{text} as text", "cast(id % 2 as double) as label")


def train(spark: SparkSession, findings: DataFrame | None = None) -> str:
    """The trained forest as an SQL expression over the features struct f: the share of votes."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    labelled = _texts(spark, FINDINGS) if findings is None else findings.select("text", F.col("label").cast("double").alias("label"))
    rows = labelled.where("text is not null and label is not null").select(F.expr(f"get({_candidates('text')}, 0)").alias("x"), "label").where("x is not null").select("label", F.expr(_features("x")).alias("f")).select("label", "f.*")
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(table.select("label", "features"))
    return "(" + " + ".join(_sql_of(t.toDebugString) for t in forest.trees) + f") / {forest.getNumTrees}"


def _sql_of(tree: str) -> str:
    """A printed tree as nested CASE expressions."""
    names = list(FEATURES)
    lines = [x.strip() for x in tree.splitlines() if x.strip().startswith(("If", "Else", "Predict"))]

    def node(at: int) -> tuple[str, int]:
        if lines[at].startswith("Predict"):
            return lines[at].split(":")[1].strip() + "D", at + 1
        m = re.match(r"If \(feature (\d+) <= ([-0-9.Ee]+)\)", lines[at])
        yes, at = node(at + 1)
        no, at = node(at + 1)  # past the line Else
        return f"CASE WHEN f.{names[int(m[1])]} <= {m[2]}D THEN {yes} ELSE {no} END", at

    return node(0)[0]


def scan(docs: DataFrame, forest: str, *, text: str = "text", findings: str = "findings") -> DataFrame:
    """The rows with an array of findings: at (from 0, in characters), length and score (share of votes)."""
    vote = f"transform(array({_features('x')}), f -> {forest})[0]"
    sql = f"transform({_candidates(f'`{text}`')}, x -> struct(x.at as at, length(x.c) as length, {vote} as score))"
    none = F.expr("cast(array() as array<struct<at:int,length:int,score:double>>)")
    return docs.withColumn(findings, F.coalesce(F.when(F.col(text).isNotNull(), F.expr(sql)), none))


def mask(docs: DataFrame, forest: str, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows with every secret in the text replaced by MASK; everything else as it was."""
    cut = "transform(secrets, (s, i) -> concat(substr(t, if(i > 0, secrets[i - 1].at + secrets[i - 1].length, 0) + 1, s.at - if(i > 0, secrets[i - 1].at + secrets[i - 1].length, 0)), '" + MASK + "'))"
    last = "substr(t, secrets[size(secrets) - 1].at + secrets[size(secrets) - 1].length + 1)"
    found = fresh(docs, "findings")
    sql = f"transform(array(filter(`{found}`, s -> s.score >= {threshold})), secrets -> if(size(secrets) > 0, transform(array(`{text}`), t -> concat(array_join({cut}, ''), {last}))[0], `{text}`))[0]"
    return scan(docs, forest, text=text, findings=found).withColumn(text, F.coalesce(F.expr(sql), F.col(text))).select(*docs.columns)
