"""Personal data and secrets by candidate gradient boosting, with DataFrame functions only.

High-recall generators propose spans that may overlap: the four strict formats and six loose ones
(disguised mail addresses, defanged and long IP addresses, cards and phone numbers with any
separators, account numbers, key-like strings). Each candidate carries format features (digits,
groups, separators, checksums, alphabet) and context features (words before it, characters that
touch it). Gradient-boosted trees (Spark ML) tell which loose candidates to redact; the level of
each kind is calibrated to PRECISION. Valid strict matches always stay, whatever the trees say.

No table holds labels for what the strict formats miss, so the trees learn from planted cases:
the values of plants(), each in the surroundings of real text (without its digits) of a bounded
sample of documents. Positives are
personal data in forms that no strict format takes, keys and secrets, all with fresh digits and valid
checksums; negatives are their look-alikes (failed checksums, dates, amounts, versions, order
numbers, file names, hashes). A candidate is positive only if it has the planted kind and ends; other
candidates on a planted value are negative. What the sampled texts hold themselves is not labelled.
A quarter of the documents is kept from the trees and calibrates the levels.

Positions: the text is split at the matches, so a match starts after the lengths of all gaps and
matches before it, summed in a window over the candidates of the document. Lookbehinds, bounds and
possessive repeats keep all patterns linear; \\G lets a match start where the last ended.

Defined results: null text counts as empty and has no span; equal rows, also of equal doc_id,
are searched each on its own. An added span crosses no base span, and of added spans that cross, one
goes if the other is likelier, then earlier by generator and place. An empty table gives an empty
table. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import hash_sample, written

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
#: The kinds with a strict format.
BASE_KINDS = KINDS[:4]
#: (kind, strict, pattern): fixed values of the strict formats, then the loose generators.
GENERATORS = [
    ("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Z0-9-]{1,63}+(?:(?:\.| \. | ?(?:\(dot\)|\[dot\]) ?| dot )[A-Z0-9-]{1,63}+){1,4}"),
    ("ip", False, r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}+(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]| dot ) ?[0-9]{1,3}+){3}(?![0-9])|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]))"),
    ("card", False, r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}(?![0-9])"),
    ("phone", False, r"(?<![0-9A-Za-z+])\(?[0-9](?:[\x20()./_-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"),
    ("iban", False, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("secret", False, r"(?<![A-Za-z0-9+/_~-])(?=[A-Za-z+/_~-]{0,40}[0-9])[A-Za-z0-9+/_~-]{12,}+={0,2}"),
]
LOOSE = [g for g, (_, strict, _) in enumerate(GENERATORS) if not strict]
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Words before a candidate that tell its kind.
CONTEXT = {
    "says_mail": r"(?i)mail|contact|write", "says_phone": r"(?i)phone|\btel|call|fax|mobil", "says_card": r"(?i)card|visa|credit|payment",
    "says_host": r"(?i)\bip\b|host|server|address", "says_key": r"(?i)token|secret|passw|pwd|api.?key|access.?key|private.?key|bearer|credential",
    "says_hash": r"(?i)commit|hash|checksum|sha-?[0-9]|md5|revision|digest|base64", "says_number": r"(?i)version|page|section|isbn|order|invoice|\bno\b|number|file|build|\bid\b",
    "assigned": r"[=:]\s?[\"']?$",
}
FEATURES = [*(f"is_{k}" for k in KINDS), "n_chars", "n_digits", "n_dots", "n_blanks", "n_hyphens", "n_brackets", "n_other", "n_upper", "n_lower", "n_alphabet", "n_turns",
            "n_groups", "first_group", "last_group", "at", "luhn", "octets", "mod97", "date", "hex", "touch_left", "touch_right", "quoted", *CONTEXT]
#: Documents whose surroundings the planted cases take, at most twice as many.
SAMPLE_ROWS = 60
PRECISION = 0.99


def luhn_sum(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def mod97(account: Column) -> Column:
    """The remainder of an account number (country, check digits, account) by 97; 1 if it is valid."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.left(account, F.lit(4)))
    number = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), lambda acc, x: (acc * F.when(number(x) > 9, 100).otherwise(10) + number(x)) % 97)


def _count(value: Column, out: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, out, ""))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each proposal of each generator, and one with null `value` at least for each
    row of `docs`: row_id, doc_id, g, kind, strict, begin, stop, value, valid and FEATURES."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_digit, has_at = F.col("text").rlike("[0-9]"), F.contains(F.col("text"), F.lit("@"))
    spelled = has_at | F.col("text").rlike(r"(?i)[(\[]at[)\]]") | (F.col("text").rlike("(?i) at ") & F.col("text").rlike("(?i) dot "))
    found = []
    for g, (kind, strict, pattern) in enumerate(GENERATORS):
        live = F.when((has_at if strict else spelled) if kind == "email" else has_digit, text).otherwise("")
        gap = F.transform(F.split(live, pattern, -1), lambda x: F.struct(
            F.length(x).alias("len"), F.right(x, F.lit(24)).alias("before"), F.left(x, F.lit(1)).alias("touch")))
        found.append(F.struct(F.lit(g).alias("g"), F.lit(kind).alias("kind"), F.lit(strict).alias("strict"),
                              F.regexp_extract_all(live, F.lit(pattern), F.lit(0)).alias("m"), gap.alias("gap")))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("row_id", "doc_id", F.inline(F.array(*found)))
    after = F.expr("slice(gap, 2, size(gap))")
    rows = rows.select("row_id", "doc_id", "g", "kind", "strict", F.posexplode(F.arrays_zip(
        F.col("m").alias("value"), F.col("gap").alias("gap"), after.alias("after"))).alias("k", "c"))
    rows = rows.where("c.value is not null or g = 0 and k = 0")
    w = Window.partitionBy("row_id", "g").orderBy("k")
    size = F.coalesce(F.length("c.value"), F.lit(0))
    stop = F.sum(F.col("c.gap.len") + size).over(w)
    rows = rows.select("row_id", "doc_id", "g", "kind", "strict", (stop - size).cast("long").alias("begin"), stop.cast("long").alias("stop"), F.col("c.value").alias("value"),
                       F.coalesce("c.gap.before", F.lit("")).alias("before"), F.coalesce("c.after.touch", F.lit("")).alias("touch"))
    value = F.col("value")
    digits = F.regexp_replace(value, "[^0-9]", "")
    n_digits = F.length(digits)
    octets = F.regexp_replace(value, r"(?i)[^0-9]+", ".").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    valid = F.when(F.col("kind") == "email", F.lit(True)).when(F.col("kind") == "ip", octets).when(
        F.col("kind") == "card", n_digits.between(16, 19) & (luhn_sum(digits) % 10 == 0)).otherwise(n_digits.between(8, 15))
    groups = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    bare = F.regexp_replace(value, " ", "")
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    told = {
        **{f"is_{k}": flag(F.col("kind") == k) for k in KINDS}, "n_chars": F.length(value), "n_digits": n_digits, "n_dots": _count(value, r"\."), "n_blanks": _count(value, " "),
        "n_hyphens": _count(value, "-"), "n_brackets": _count(value, r"[()\[\]]"), "n_other": _count(value, r"[^A-Za-z0-9 .()\[\]-]"), "n_upper": _count(value, "[A-Z]"),
        "n_lower": _count(value, "[a-z]"), "n_alphabet": F.size(F.array_distinct(F.regexp_extract_all(F.left(value, F.lit(200)), F.lit("."), F.lit(0)))),
        "n_turns": _count(F.left(value, F.lit(200)), "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"), "n_groups": F.size(groups), "first_group": F.length(F.get(groups, F.lit(0))),
        "last_group": F.length(F.try_element_at(groups, F.lit(-1))), "at": flag(F.contains(value, F.lit("@"))), "luhn": flag(F.when(n_digits.between(12, 19), luhn_sum(digits) % 10 == 0)),
        "octets": flag(octets), "mod97": flag(F.when(F.col("kind") == "iban", mod97(bare) == 1)),
        "date": flag(value.rlike(r"(?:19|20)[0-9]{2}[./_-](?:0?[1-9]|1[0-2])[./_-][0-3]?[0-9]|[0-3]?[0-9][./-](?:0?[1-9]|1[0-2])[./-](?:19|20)[0-9]{2}")),
        "hex": flag(value.rlike("^[0-9A-Fa-f]+$")), "touch_left": flag(F.right("before", F.lit(1)).rlike(r"[\p{L}\p{N}]")), "touch_right": flag(F.col("touch").rlike(r"[\p{L}\p{N}]")),
        "quoted": flag(F.right("before", F.lit(1)).rlike("[\"'`]") & F.col("touch").rlike("[\"'`]")), **{c: flag(F.col("before").rlike(p)) for c, p in CONTEXT.items()},
    }
    return rows.select("row_id", "doc_id", "g", "kind", "strict", "begin", "stop", "value", flag(F.col("strict") & value.isNotNull() & valid).cast("boolean").alias("valid"),
                       *[F.coalesce(told[f], F.lit(0)).alias(f) for f in FEATURES])


def _digits(n: int, salt: int) -> Column:
    return F.lpad(F.pmod(F.xxhash64("seed", F.lit(salt)), F.lit(10**n)).cast("string"), n, "0")


def _hex(n: int, salt: int = 0) -> Column:
    return F.left(F.sha2(F.concat("seed", F.lit(str(salt))).cast("binary"), 256), F.lit(n))


def _letters(n: int, salt: int = 0) -> Column:
    return F.translate(_hex(n, salt), "0123456789abcdef", "etaoinshrdlucmwg")


def _base62(n: int, salt: int = 0) -> Column:
    return F.left(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat("seed", F.lit(f"b{salt}")).cast("binary"), 512))), "[+/=]", ""), F.lit(n))


def _octet(salt: int, top: int = 256) -> Column:
    return F.pmod(F.xxhash64("seed", F.lit(salt)), F.lit(top)).cast("string")


def _form(pattern: str) -> Column:
    """Digits for each {n}, e.g. `{3}-{4}`."""
    parts = []
    for k, part in enumerate(pattern.replace("{", "\0{").replace("}", "}\0").split("\0")):
        if part:
            parts.append(_digits(int(part[1:-1]), 31 * k + len(pattern)) if part[0] == "{" else F.lit(part))
    return F.concat(*parts)


def _grouped(digits: Column, sizes: tuple[int, ...], mark: str) -> Column:
    at, parts = 1, []
    for n in sizes:
        parts.append(F.substring(digits, at, n))
        at += n
    return F.concat_ws(mark, *parts)


def _card(n: int, off: int = 0) -> Column:
    """`n` digits that pass the Luhn check, or miss it by `off`."""
    body = _digits(n - 1, 77)
    return F.concat(body, F.pmod(F.lit(off) - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))


def _iban(off: int = 0) -> Column:
    body = _digits(18, 78)
    check = F.pmod(F.lit(98 + off) - mod97(F.concat(F.lit("DE00"), body)), F.lit(97))
    return F.concat(F.lit("DE"), F.lpad(check.cast("string"), 2, "0"), body)


def plants() -> list[tuple[str | None, str, Column, str]]:
    """(kind or None, text before, value, text after)."""
    four, out = (4, 4, 4, 4), []
    name, host = F.concat(_letters(5, 1), F.lit("."), _letters(4, 2)), _letters(7, 3)
    for lead in ("", "phone: ", "call ", "fax "):
        out += [("phone", lead, _form(f), "") for f in ("({3}) {3}-{4}", "{3}-{3}-{4}", "{3} {3} {4}", "00{2} {3} {7}", "0{3}/{7}", "0{3} {3} {3}", "{3}.{3}.{4}")]
    out += [("phone", lead, _form(f), "") for lead in ("phone ", "tel. ", "mobile: ") for f in ("{10}", "0{9}")]
    for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" @ ", "."), (" @ ", " . ")):
        out += [("email", lead, F.concat(name, F.lit(at), host, F.lit(dot), F.lit(end)), "") for lead in ("", "mail: ") for end in ("com", "org")]
    out += [(None, lead, F.concat(_letters(n, 24), F.lit(" at "), host, F.lit(f".{end}")), "") for lead in ("", "look ", "mail ") for n in (2, 5) for end in ("com", "txt")]
    for dot in ("[.]", "(.)", " . ", "[dot]", " dot "):
        out += [("ip", lead, F.concat_ws(dot, *[_octet(k) for k in range(4)]), "") for lead in ("", "server ")]
    out.append(("ip", "", F.concat_ws(":", *[_hex(4, k) for k in range(8)]), ""))
    for mark in (".", "/", "_", "  ", " - ", ". "):
        out += [("card", lead, _grouped(_card(16), four, mark), "") for lead in ("", "card ", "visa: ")]
        out += [(None, lead, _grouped(_card(16, off), four, mark), "") for lead, off in (("", 3), ("card ", 7))]
    out += [("card", lead, _grouped(_card(15), (4, 6, 5), mark), "") for lead in ("card ", "credit card: ") for mark in (" ", "-", "")]
    for sizes in ((22,), (4, 4, 4, 4, 4, 2)):
        out += [("iban", "", _grouped(_iban(), sizes, " "), ""), (None, "", _grouped(_iban(5), sizes, " "), "")]
    values = [_hex(40), _hex(32, 4), F.upper(_hex(40, 5)), _hex(64, 6), _base62(32), _base62(24, 1), _base62(64, 2), F.concat(F.lit("AKIA"), F.upper(_base62(16, 3)))]
    for lead, tail in (('token = "', '"'), ("api_key: ", ""), ('"secret": "', '"'), ("password=", ""), ("Bearer ", ""), ("ACCESS_KEY='", "'"), ('TOKEN = "', '"')):
        out += [("secret", lead, v, tail) for v in values]
    out += [("secret", lead, _base62(n, n), tail) for lead, tail in (('token = "', '"'), ("password: ", ""), ("pwd=", "")) for n in (14, 18)]
    for lead in ("commit ", "sha256: ", "md5=", "revision ", "checksum: ", "digest = "):
        out += [(None, lead, v, "") for v in values[:4]]
    out += [(None, lead, _form(f), "") for lead in ("", "order ", "number ", "no ") for f in ("{7}", "{8}", "{9}", "{10}", "{11}", "{12}", "{13}", "{14}", "{15}")]
    out += [(None, lead, v, "") for lead in ("", "order ", "invoice ") for v in (_card(16, 2), _card(16, 9), _grouped(_card(16, 4), four, " "), _form("{17}"), _form("{18}"))]
    year, month = F.concat(F.lit("20"), _digits(2, 61)), F.lpad((F.pmod(F.xxhash64("seed", F.lit(62)), F.lit(12)) + 1).cast("string"), 2, "0")
    day = F.lpad((F.pmod(F.xxhash64("seed", F.lit(63)), F.lit(28)) + 1).cast("string"), 2, "0")
    out += [(None, lead, F.concat_ws(mark, *parts), tail) for mark in ("-", "/", ".") for parts in ((year, month, day), (day, month, year)) for lead, tail in (("", ""), ("on ", " 10:30"))]
    out += [(None, lead, F.concat_ws(mark, *[_digits(3, k) for k in range(n)]), "") for lead in ("", "$ ", "total ") for mark in (".", " ") for n in (3, 4, 5)]
    out += [(None, "ISBN ", _form("978-{1}-{2}-{6}-{1}"), ""), (None, "isbn ", _form("978{10}"), ""), (None, "", _form("{4}-{4}"), ""), (None, "page ", _form("{4}-{4}"), "")]
    out += [(None, lead, F.concat_ws(".", F.lit("10"), F.lit("0"), _form("1{4}"), _form("{3}")), "") for lead in ("version ", "build ", "")]
    out += [(None, lead, F.concat_ws(dot, _form("3{2}"), _form("4{2}"), _octet(1), _octet(2)), "") for lead in ("", "section ") for dot in ("[.]", " . ", " dot ")]
    day_path = F.concat_ws("/", year, month, day)
    out += [(None, lead, v, "") for lead in ("", "file ", "id ") for v in (
        F.concat(F.lit("IMG_"), year, month, day, F.lit("_"), _digits(6, 64)), F.concat(_letters(6, 7), F.lit("_final_v2_"), year), F.concat(day_path, F.lit("/"), _letters(5, 8), F.lit("-"), _letters(7, 9)),
        F.concat_ws("-", F.upper(_letters(4, 10)), _digits(4, 65), F.upper(_letters(4, 11))), F.concat(F.lit("INV-"), year, F.lit("-"), _digits(6, 66)), F.concat(_letters(9, 12), _digits(3, 67), _letters(6, 13)),
        F.concat_ws("-", _letters(6, 14), _digits(1, 68), _letters(8, 15), _letters(5, 16)), F.concat_ws("-", _hex(8, 17), _hex(4, 18), _hex(4, 19), _hex(4, 20), _hex(12, 21)))]
    out += [(None, "base64,", F.concat(F.lit("iVBORw0KGgo"), _base62(60, 5)), ""), (None, "", _form("{18}{9}"), "")]
    out += [(None, lead, F.concat(_letters(n, 22), F.lit(mid), _digits(k, 69), F.lit("."), _digits(2, 70)), "") for lead in ("", "price ") for n in (3, 6) for mid, k in ((" @ ", 1), (" @ ", 3))]
    return out


def planted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(plant, seed, kind, begin, stop, text): every case in the surroundings of each sampled document."""
    count = docs.count()
    some = hash_sample(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), F.xxhash64("id", "text"), SAMPLE_ROWS, 10, count)
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[0-9@]", "")
    at = F.pmod(F.xxhash64("id", "text", F.lit(1)), F.greatest(F.length(text) - 90, F.lit(1))).cast("int")
    around = some.select(F.xxhash64("id", "text").alias("doc"), F.substring(text, at + 1, F.lit(40)).alias("left"), F.substring(text, at + 41, F.lit(40)).alias("right"))
    cases = [F.struct(F.lit(k).alias("case"), F.lit(kind).cast("string").alias("kind"), F.lit(lead).alias("lead"), value.alias("value"), F.lit(tail).alias("tail"))
             for k, (kind, lead, value, tail) in enumerate(plants())]
    rows = around.distinct().repartition(16, "doc").withColumn("seed", F.col("doc").cast("string")).select("doc", "left", "right", F.explode(F.array(*cases)).alias("c"))
    before = F.concat("left", F.lit(" "), "c.lead")
    return rows.select(F.xxhash64("doc", "c.case").alias("plant"), "doc", F.col("c.kind").alias("planted"), F.length(before).cast("long").alias("from"),
                       (F.length(before) + F.length("c.value")).cast("long").alias("to"), F.concat(before, F.col("c.value"), F.col("c.tail"), F.lit(" "), F.col("right")).alias("text"))


def examples(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Loose candidates on planted values with `label`: 1 if kind and ends are the planted ones."""
    table = written(planted(docs, id_col, text_col), "pii-plants")
    found = candidates(table.select("plant", "text"), "plant", "text").where("not strict and value is not null")
    on = found.join(table.drop("text"), found["doc_id"] == table["plant"]).where("begin < to and from < stop")
    hit = (F.col("kind") == F.col("planted")) & (F.col("begin") == F.col("from")) & (F.col("stop") == F.col("to"))
    return written(on.select("doc", "kind", *FEATURES, F.coalesce(hit, F.lit(False)).cast("double").alias("label")), "pii-examples")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[PipelineModel | None, dict[str, float]]:
    """Trees and the level of each kind, from the planted cases of at most 2 * SAMPLE_ROWS documents."""
    some = examples(docs, id_col, text_col)
    if not some.take(1):
        return None, {}
    to_vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    held = F.pmod("doc", F.lit(4)) == 0
    if not some.where(~held).take(1) or not some.where(held).take(1):
        held = None  # a document or two: the same cases teach and calibrate
    taught = some if held is None else some.where(~held)
    sizes = {r["kind"]: r["count"] for r in taught.groupBy("kind").count().collect()}  # at most 6 rows
    weight = F.coalesce(*[F.when(F.col("kind") == k, F.lit(1000.0 / n)) for k, n in sizes.items()])  # kinds count alike
    learn = to_vector.transform(taught).select("features", "label", weight.alias("weight"))
    trees = GBTClassifier(maxIter=12, maxDepth=7, stepSize=0.4, minInstancesPerNode=5, weightCol="weight", seed=10).fit(learn)
    model = PipelineModel([to_vector, trees])
    checked = model.transform(some if held is None else some.where(held)).select("kind", "label", F.floor(vector_to_array("probability")[1] * 100).alias("p"))
    counts = checked.groupBy("kind", "p").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()  # at most 6 * 101 rows
    level = {}
    for kind in KINDS:
        good = total = 0
        for r in sorted((r for r in counts if r["kind"] == kind), key=lambda r: -r["p"]):
            good, total = good + r["good"], total + r["n"]
            if good >= PRECISION * total and r["p"] >= 50:
                level[kind] = r["p"] / 100
    return model, level


def chosen(told: DataFrame, base: DataFrame) -> DataFrame:
    """`told(row_id, g, kind, begin, stop, p)` without spans that cross one of `base(row_id, begin,
    stop)` or a likelier one. The spans of one generator never cross each other, so the earlier of
    two that cross is the last of its generator before the later: each pair is met once. All frames run
    from the first row of their order, so a text with many spans costs no more for each."""
    rows = told.select("row_id", "g", "kind", "begin", "stop", "p").unionByName(
        base.select("row_id", F.lit(-1).alias("g"), F.lit(None).cast("string").alias("kind"), "begin", "stop", F.lit(2.0).alias("p")))
    w = Window.partitionBy("row_id").orderBy("begin", "g")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("row_id").orderBy(F.desc("begin"), F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("g") < 0
    rows = rows.withColumn("hit", (F.max(F.when(own, F.col("stop"))).over(earlier) > F.col("begin")) | (F.min(F.when(own, F.col("begin"))).over(later) < F.col("stop")))
    rows = rows.where(~own & ~F.coalesce("hit", F.lit(False)))
    rank = lambda p, g, at: F.struct((-p).alias("p"), g.alias("g"), at.alias("begin"))
    lost, mine = [], rank(F.col("p"), F.col("g"), F.col("begin"))
    for g in LOOSE:
        rows = rows.withColumn(f"last{g}", F.last(F.when(F.col("g") == g, F.struct("p", "g", "begin", "stop")), ignorenulls=True).over(earlier))
        a = F.col(f"last{g}")
        other = rank(a["p"], a["g"], a["begin"])
        loser = F.when(other < mine, F.struct("g", "begin")).otherwise(F.struct(a["g"].alias("g"), a["begin"].alias("begin")))
        lost.append(F.when((F.col("g") != g) & (a["stop"] > F.col("begin")), loser))
    span = F.struct("g", "begin", "kind", "stop")
    each = F.array(F.struct(F.col("g").alias("g"), F.col("begin").alias("begin"), span.alias("span")), *[
        F.struct(x["g"].alias("g"), x["begin"].alias("begin"), F.when(F.lit(False), span).alias("span")) for x in lost])
    events = rows.select("row_id", F.inline(each)).where("g is not null")
    kept = events.groupBy("row_id", "g", "begin").agg(F.max("span").alias("span"), F.count_if(F.col("span").isNull()).alias("lost")).where("lost = 0 and span is not null")
    return kept.select("row_id", "span.kind", "span.begin", "span.stop")


def _place(kind: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1).cast("int")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, base and added, arrays of (kind number in KINDS,
    begin, stop) in code points, stop exclusive, sorted."""
    found = written(candidates(docs, id_col, text_col), "pii-candidates")
    model, level = fit(docs, id_col, text_col)
    base = found.where("valid").select("row_id", "kind", "begin", "stop")
    rows = found.select("row_id", "doc_id", F.when(F.col("valid"), F.struct(_place(F.col("kind")).alias("kind"), "begin", "stop")).alias("base"))
    if model is not None and level:
        least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in level.items()], F.lit(2.0))
        told = model.transform(found.where("not strict and value is not null")).withColumn("p", vector_to_array("probability")[1]).where(F.col("p") >= least)
        added = chosen(told, base).select("row_id", F.struct(_place(F.col("kind")).alias("kind"), "begin", "stop").alias("added"))
        rows = rows.unionByName(added, allowMissingColumns=True)
    else:
        rows = rows.withColumn("added", F.when(F.lit(False), F.col("base")))
    each = rows.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list("base")).alias("base"), F.array_sort(F.collect_list("added")).alias("added"))
    return each.drop("row_id")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["begin"].cast("string"), s["stop"].cast("string"))))


def report(found: DataFrame) -> DataFrame:
    """The digest columns of spans(), and the numbers of added and of all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)],
                        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans"),
                        F.size("added").cast("long").alias("n_added"), F.size(every).cast("long").alias("n_spans"))

def redact(text: Column, found: Column) -> Column:
    """The text with [kind] in place of each of the sorted spans `found`."""
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["begin"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when(s["begin"] >= acc["at"], F.concat(F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))).otherwise("")
        return F.struct(F.concat(acc["out"], kept, mark).alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))
    by_place = F.array_sort(found, lambda a, b: F.when(a["begin"] < b["begin"], -1).when(a["begin"] > b["begin"], 1).otherwise(0))
    return F.aggregate(by_place, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
