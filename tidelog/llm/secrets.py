"""Secret scans: candidates by pattern, false positives removed by a random forest.

DataFrame functions only: texts are split at candidate strings, so the pieces give each
candidate's place and neighbours; features are expressions; the forest is fitted by the ML library on labelled
findings and its trees become expressions too.
"""

from __future__ import annotations

import random
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names that say a secret follows, with what may stand between: a sign, a quote, a space.
NAMED = r"(?:passw|pwd|secret|token|bearer|credential|(?:api|private|access)[ _-]?key)[A-Za-z0-9_-]{0,16}[\"']?(?:\s{0,2}[=:]\s{0,2}|\s{1,2})"
#: What follows such a name, 8 characters or more: to the quote, or unquoted to a space, a quote, a tag or a separator before a further name;
#: else a run of 16 characters or more that is not a single word in small letters.
CANDIDATE = (
    rf"(?<=[\"'])(?=[^\s\"']{{8}})(?<=(?i:{NAMED})[\"'])[^\s\"']{{8,}}+"
    rf"|(?<=[\s=:])(?=[^\s\"'=:<>][^\s\"']{{7}})(?<=(?i:{NAMED}))(?:(?![,;&](?:\s|$|[\w.-]{{1,30}}[=:])|</)[^\s\"']){{8,}}+"
    r"|(?<![A-Za-z0-9+/_.-])(?![A-Za-z][a-z]*(?![A-Za-z0-9+/_.-]))(?=[+/_.-]*[A-Za-z0-9])[A-Za-z0-9+/_.-]{16,}={0,2}"
)
#: Characters before and after a candidate that its neighbouring words are taken from.
NEAR = 40
TREES, DEPTH, THRESHOLD = 40, 8, 0.5

# Words that speak for or against a secret beside it, and words that codes of other kinds hold.
FOR = "token|secret|passwd|password|pwd|apikey|api_key|api-key|auth|credential|private|bearer|access|signature|key"
AGAINST = "commit|sha1|sha256|md5|hash|digest|checksum|uuid|guid|version|build|order|invoice|phone|isbn|example|sample|test|http|https|www|href|src|img|file|path"
DICTIONARY = (
    "example|sample|test|user|name|your|here|data|file|image|index|page|public|static|config|default|version|release|update|value|string|number|"
    "class|object|array|table|model|server|client|service|module|package|order|invoice|report|document|xxxx|1234|abcd|html|http|www|com|org|the|and|for|with"
)
FEATURES = ("length", "transitions", "case_turns", "bigrams", "distinct", "digits", "hexadecimal", "dictionary", "slashes", "in_path", "quoted", "for", "against", "dashes", "kinds", "word_run")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, finding, start, candidate, before, after): each candidate of the whole texts, in order from 0.

    A text becomes a row for each candidate with its neighbours and the length before it; places are running sums of those
    lengths over a text's rows, so the work is in proportion to the text whatever the number of candidates.
    """
    rows = docs.where(F.col(text).rlike(CANDIDATE)).select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.split(F.col(text), CANDIDATE).alias("gaps"), F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0)).alias("found"))
    pieces = F.transform(
        "found",
        lambda hit, i: F.struct(hit.alias("candidate"), F.char_length(F.get("gaps", i)).alias("gap"), F.right(F.get("gaps", i), F.lit(NEAR)).alias("before"), F.left(F.get("gaps", i + 1), F.lit(NEAR)).alias("after")),
    )
    rows = rows.select("key", "row", F.posexplode(pieces).alias("finding", "piece")).select("key", "row", "finding", "piece.*")
    ahead = Window.partitionBy("row").orderBy("finding").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("gap") + F.coalesce(F.sum(F.col("gap") + F.char_length("candidate")).over(ahead), F.lit(0))
    return rows.select(F.col("key").alias(key), "finding", start.cast("long").alias("start"), "candidate", "before", "after")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _share(c: Column, pattern: str) -> Column:
    return (F.char_length(c) - F.char_length(F.regexp_replace(c, pattern, ""))) / F.greatest(F.char_length(c), F.lit(1))


def featured(found: DataFrame, turns: dict[str, float]) -> DataFrame:
    """found with a double column f_<name> for each of FEATURES; turns has a weight for each pair of characters."""
    c, before, n = F.col("candidate"), F.lower(F.coalesce("before", F.lit(""))), F.greatest(F.char_length("candidate"), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in sorted(turns.items()) for x in kv]) if turns else F.create_map(F.lit(""), F.lit(0.0))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(F.element_at(table, F.lower(F.substr(c, i, F.lit(2)))), F.lit(0.0)))
    values = {
        "length": n,
        "transitions": _count(c, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])") / n,
        "case_turns": _count(c, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "bigrams": F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "digits": _share(c, "[0-9]"),
        "hexadecimal": _share(c, "[0-9a-f]"),
        "dictionary": _share(F.lower(c), DICTIONARY),
        "slashes": _count(c, "[/.]"),
        "in_path": F.when(before.rlike(r"[/\\.@?&%#]$|https?:\S*$") | F.coalesce("after", F.lit("")).rlike(r"^[/\\@]"), 1).otherwise(0),
        "quoted": F.when(before.rlike("[\"'=:]\\s*[\"']?$"), 1).otherwise(0),
        "for": F.when(before.rlike(rf"\b\w*({FOR})\w*\W*$"), 2).when(before.rlike(FOR), 1).otherwise(0),
        "against": F.when(before.rlike(rf"\b({AGAINST})\w*\W*$"), 2).when(before.rlike(AGAINST), 1).otherwise(0),
        "dashes": _count(c, "[-_]"),
        "kinds": sum((F.when(c.rlike(k), 1).otherwise(0) for k in ("[A-Z]", "[0-9]", "[^A-Za-z0-9_./-]")), F.when(c.rlike("[a-z]"), 1).otherwise(0)),
        "word_run": F.array_max(F.transform(F.split(F.lower(c), "[^a-z]+"), F.char_length)) / n,
    }
    return found.withColumns({f"f_{k}": v.cast("double") for k, v in values.items()})


class Forest:
    """A fitted forest as a column: the mean over trees of a leaf's share of true findings."""

    def __init__(self, turns: dict[str, float], trees: list):
        self.turns, self.trees = turns, trees

    def score(self) -> Column:
        def column(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, low, high = node
            return F.when(F.col(f"f_{FEATURES[feature]}") <= threshold, column(low)).otherwise(column(high))

        if not self.trees:
            return F.lit(0.5)
        total = column(self.trees[0])
        for t in self.trees[1:]:
            total = total + column(t)
        return F.round(total / len(self.trees), 9)


def _tree(node):
    """Nested (feature, threshold, low, high), or a leaf's share."""
    if node.numDescendants() == 0:
        stats = [float(x) for x in node.impurityStats().stats()]
        return stats[1] / (sum(stats) or 1)
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 0) -> Forest:
    """A forest from labelled findings (candidate, before, after, label 0 or 1); null labels and candidates are left out."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    labelled = labelled.select("candidate", "before", "after", "label").where("candidate is not null and label is not null")
    pairs = labelled.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("candidate") - 1, F.lit(1))), lambda i: F.lower(F.substr(F.col("candidate"), i, F.lit(2))))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no"))
    odds = counts.withColumn("all", F.col("yes") + F.col("no")).orderBy(F.desc("all"), "pair").limit(800)
    turns = {r["pair"]: r["odds"] for r in odds.select("pair", F.round(F.log((F.col("yes") + 1) / (F.col("no") + 1)), 6).alias("odds")).collect()}
    rows = featured(labelled, turns).select("candidate", "before", F.col("label").cast("double").alias("label"), *[f"f_{f}" for f in FEATURES])
    if rows.select("label").distinct().count() < 2:
        return Forest(turns, [])
    rows = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features").transform(rows.orderBy("candidate", "before").coalesce(1))
    model = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
    return Forest(turns, [_tree(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees])


def labelled_findings(spark: SparkSession, n: int = 3_600, seed: int = 1) -> DataFrame:
    """Findings with known labels, drawn from the forms that keys and look-alikes have."""
    rnd = random.Random(seed)
    alphabets = {"hex": "0123456789abcdef", "b64": string.ascii_letters + string.digits + "+/", "url": string.ascii_letters + string.digits + "-_", "up": string.ascii_uppercase + string.digits}
    words = [w for w in DICTIONARY.split("|") if w.isalpha()] + "thing other under over again world house water light night story right small large place point group".split()

    def drawn(kind: str, k: int) -> str:
        return "".join(rnd.choices(alphabets[kind], k=k))

    rows = []
    for _ in range(n):
        noise = " ".join(rnd.choices(words, k=rnd.randrange(5)))
        name = rnd.choice(["token", "secret", "api_key", "password", "auth_token", "AWS_SECRET", "client_secret", "bearer", "private key", "access token", "apikey", "PASSWORD"])
        sign = rnd.choice([" = \"", "=", ": ", " = '", ": \"", ' "', " "])
        form = rnd.randrange(19)
        if form == 0:
            rows.append((drawn("hex", rnd.choice([32, 40, 64])), f"{noise} {name}{sign}", '" ', 1))
        elif form == 1:
            rows.append((drawn("b64", rnd.choice([32, 40, 44, 64])), f"{noise} {name}{sign}", '" ', 1))
        elif form == 2:
            rows.append((rnd.choice(["AKIA" + drawn("up", 16), "ghp_" + drawn("url", 36).replace("-", "a").replace("_", "b"), "sk_live_" + drawn("url", 24), "xoxb-" + drawn("url", 40)]), f"{noise}{rnd.choice([' ', f' {name}{sign}'])}", " ", 1))
        elif form == 3:
            rows.append((drawn("url", rnd.randrange(20, 50)), f"{noise} {name}{sign}", '" ', 1))
        elif form == 4:
            rows.append(("".join(rnd.choices(string.ascii_letters + string.digits + "!#$%", k=rnd.randrange(8, 20))), f"{noise} {rnd.choice(['password', 'pwd', 'passwd'])}{sign}", '" ', 1))
        elif form == 5:
            rows.append((drawn("hex", rnd.choice([32, 40, 64])), f"{noise} {rnd.choice(['commit', 'sha256', 'md5', 'checksum:', 'digest', 'hash'])}{rnd.choice([' ', ': ', '='])}", " ", 0))
        elif form == 6:
            h = drawn("hex", 32)
            rows.append((f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", f"{noise} {rnd.choice(['id', 'uuid', 'request', ''])} ", " ", 0))
        elif form == 7:
            rows.append(("/".join(rnd.choices(words, k=rnd.randrange(2, 5))) + f"/{rnd.randrange(1000)}.html", f"{noise} {rnd.choice(['https://www.', 'http://', 'src=/', ' /'])}", " ", 0))
        elif form == 8:
            rows.append((rnd.choice("_-.").join(rnd.choices(words, k=rnd.randrange(3, 6))) + str(rnd.randrange(100)), f"{noise} {rnd.choice(['', 'file ', 'version ', f'{name}{sign}'])}", " ", 0))
        elif form == 9:
            rows.append(("".join(rnd.choices(string.digits, k=rnd.randrange(16, 24))), f"{noise} {rnd.choice(['order ', 'invoice ', 'phone ', ''])}", " ", 0))
        elif form == 10:
            rows.append((rnd.choice(["your_api_key_here_1", "xxxxxxxxxxxxxxxxxxx1", "example-token-123456", "1234567890123456", "abcdefabcdef1234567890", "changeme123456789"]), f"{noise} {name}{sign}", '" ', 0))
        elif form == 11:
            rows.append(("".join(rnd.choices(words, k=4)) + str(rnd.randrange(100)), f"{noise} ", " ", 0))
        elif form in (12, 18):
            blocks = "".join("".join(rnd.choices([string.ascii_lowercase, string.ascii_uppercase][i % 2], k=rnd.randrange(2, 6))) for i in range(rnd.randrange(5, 11)))
            rows.append((rnd.choice([blocks.ljust(16, "q"), "".join(rnd.choices(string.ascii_letters, k=rnd.randrange(16, 41)))]), f"{noise} {name}{sign}", rnd.choice(['" ', " ", "\n"]), 1))
        elif form == 13:
            w = "".join(rnd.choices(words, k=rnd.randrange(1, 4))) + rnd.choice(["", "", "ation", "ization", "ments", "ness", "ability", "ingly"])
            rows.append((w + "." * max(rnd.randrange(2), 8 - len(w)), f"{noise} {name}{sign}", rnd.choice([" ", '" ', "\n"]), 0))
        elif form == 14:
            some = rnd.choices(words, k=rnd.randrange(4, 7))
            rows.append((rnd.choice(["-", "/", "_", "."]).join(some) + rnd.choice(["", "."]), f"{noise} ", " ", 0))
        elif form == 15:
            site, page = rnd.choices(words, k=2)
            rows.append((drawn(rnd.choice(["hex", "hex", "url"]), rnd.choice([24, 32, 40])), f"{noise} {rnd.choice(['https://www.', 'http://', 'href=', ''])}{site}.{rnd.choice(['org', 'com', 'net'])}/{page}/", rnd.choice(["/index.html", "/", ".png ", " "]), 0))
        elif form == 16:
            rows.append((drawn("hex", rnd.choice([16, 24, 32, 40, 64])), f"{noise} {rnd.choice([*words, 'order', 'record', 'item', 'row', 'etag:', 'revision'])} ", rnd.choice([" ", ", ", "\n"]), 0))
        else:
            some = rnd.choices(words, k=rnd.randrange(4, 7))
            rows.append((rnd.choice([some[0] + "".join(map(str.title, some[1:])), "_".join(some).upper(), "".join(some) + "."]), f"{noise} {rnd.choice(['', 'class ', 'the '])}", " ", 0))
    return spark.createDataFrame(rows, "candidate string, before string, after string, label int")


def scan(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, finding, start, candidate, score, is_secret): a row for each candidate of each row of docs.

    start counts code points from 0. Null, empty and candidate-free texts have no rows; rows that
    repeat repeat their findings. Whole texts are read whatever their length; other columns are not.
    """
    found = featured(candidates(docs, key, text), forest.turns).withColumn("score", forest.score())
    return found.select(key, "finding", "start", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))
