"""Secret scans: candidates by form, false positives removed by a random forest, in DataFrame operations only.

A candidate is a run of at least MIN_LENGTH key characters in a word; a word has as many as it has such runs. Whole values
of any length and characters are candidates too: those assigned to a credential word (in quotes they may go on over several words),
the two words after one, and the password of user:password@host. A candidate's features are its length, shares of digits,
upper and lower case and signs, how often each kind of character follows each other kind, distinct characters, vowels, how much of it
dictionary words cover, signs of a path or address around it, credential words in its own word and
the two before, whether it is assigned to one, and whether it is a part of a web token. The dictionary is the DICTIONARY most frequent lower-case words of the corpus, counted over all
documents.

The forest is trained on labelled findings: (id, at, place, label) rows that name candidates. Where no findings have been
labelled by hand, `labelled_by_rule` labels candidates whose form settles them either way and leaves the rest
out, and `planted` adds texts that were made with a secret or with a look-alike in them, whose labels are known from how they were made
and not from their features. At most TRAIN_FINDINGS of each label (of the tables, and as many planted ones) train it, those with the smallest hashes.

Defined results: a null or empty text has no candidates; rows with equal ids give their candidates row by row; null
ids pass through; candidates of one label only make a forest impossible and every score is that label; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import stored

MIN_LENGTH = 16
SURE_LENGTH = 8
DICTIONARY = 1000
TRAIN_FINDINGS = 2000
RUN = r"[A-Za-z0-9+/_\-]{" + str(MIN_LENGTH) + ",}"
CREDENTIAL = r"(?i)(passw|pwd|secret|token|api.?key|access.?key|auth|bearer|credential)"
#: The end of what stands before a value that is assigned to a credential word, or the value of a bearer.
GIVEN = CREDENTIAL + r"""[\w.\-]*+[\\"'`\])]*\s*[=:>]+\s*((bearer|basic|token)\s+)?[\\"'`(\[{]*$|(?i)\bbearer\s+["'`]?$"""
#: A web token: header, payload, signature.
JWT = r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+"
#: Whole values in the word that assigns them, of any length: in escaped quotes, in quotes, in none, and the password of user:password@host.
NAME = CREDENTIAL + r"""[\w.\-]*+[\\"'`\])]*+[=:>]++"""
ESCAPED = "(?s)" + NAME + r"""[\[(]*\\(["'`])(.+?)(?=\\\2)"""
QUOTED = "(?s)" + NAME + r"""[\[(]*(["'`])(.+?)(?<!\\)(?=\2)"""
PLAIN = NAME + r"""(?!\\?["'`]|[\[{(]+\\?["'`\[{])(\S+?)(?=[&,;]["']?[\w.\-]+["']?[=:]|[\\"'`,;)}\]>]*$)"""
LOGIN = r"""(?:^|[/"'`=(<,;])[^\s:/@"'`=(<,;]*:([^\s"'`/]+)@(?=[\w\[])"""
#: A quote that opens a value and isn't closed in its word.
OPENED = NAME + r"""[\[(]*(["'`][^"'`]*)$"""
OPENED_WORD = r"""^[=:>]*(["'`][^"'`]*)$"""
#: The value that a word after a credential word holds.
QUOTED_WORD = r"""(?s)^[=:>]*[\[({]*\\?(["'`])(.+?)(?<!\\)\\?\1"""
BARE_WORD = r"""^[=:>]*[\\"'`(\[{<]*(.*?)[\\"'`,;)}\]>]*$"""
KINDS = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "sign": "^A-Za-z0-9"}
#: A feature for each pair of kinds of characters: how often the second follows the first.
TRANSITIONS = {f"{a}_{b}": f"[{x}](?=[{y}])" for a, x in KINDS.items() for b, y in KINDS.items() if a != b}
FEATURES = ["length", "digits", "upper", "lower", "signs", *TRANSITIONS, "distinct", "vowels", "hex", "covered", "path", "named", "near", "assigned", "quoted", "given", "part"]
TREES, DEPTH, SEED = 30, 6, 7


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each candidate: id, at (number of the word), place (number of the candidate in the word), value, and what
    surrounds it. What depends on the whole word is told once a word, and no candidate carries its word. A word of very many
    credential words without a break takes time with the square of its length."""
    words = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+")
    read = docs.select(F.col(id_col).alias("id"), words.alias("w")).withColumn("hits", F.transform("w", lambda x: F.rlike(x, F.lit(CREDENTIAL))))
    hit = lambda i: F.get("hits", i) | F.get("hits", i - 1) | F.get("hits", i - 2)
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.rlike(F.get("w", i), F.lit(RUN)) | hit(i) | F.rlike(F.get("w", i), F.lit(LOGIN)))
    found = read.select("id", "w", F.explode(places).alias("at"))
    near = lambda d: F.coalesce(F.get("w", F.col("at") + d), F.lit(""))
    found = found.select("id", "at", "w", near(0).alias("word"), near(-1).alias("before"), near(-2).alias("before2"))
    head = F.concat_ws(" ", "before2", "before", F.lit(""))
    context = {
        "path": F.rlike("word", F.lit(r"://|^\.?\.?/|\.[a-z]{2,4}(/|$)|/.*/")),
        "named": F.rlike("word", F.lit(CREDENTIAL)),
        "near": F.rlike("before", F.lit(CREDENTIAL)) | F.rlike("before2", F.lit(CREDENTIAL)),
        "assigned": F.rlike("word", F.lit("[=:]")) | F.rlike("before", F.lit("[=:]$")),
        "quoted": F.rlike("word", F.lit("[\"'`]")),
    }
    every = lambda pattern, group: F.regexp_extract_all("word", F.lit(pattern), F.lit(group))
    part = lambda column, pattern, group: F.regexp_extract(column, pattern, group)
    # A word after a credential word, without its quotes; whether it is assigned; and the opening quote of a value that goes on in the next words.
    follows = F.when(F.col("near"), F.coalesce(F.nullif(part("word", QUOTED_WORD, 2), F.lit("")), part("word", BARE_WORD, 1))).otherwise("")
    assigned = F.col("near") & F.rlike(F.concat(head, part("word", r"""^[=:>]*[\\"'`(\[{]*""", 0)), F.lit(GIVEN))
    opened = F.coalesce(F.nullif(part("word", OPENED, 2), F.lit("")), F.when(assigned, part("word", OPENED_WORD, 1)), F.lit(""))
    found = found.select("*", *[c.alias(k) for k, c in context.items()])
    found = found.select("*", follows.alias("follows"), assigned.alias("follows_given"), opened.alias("opened"))
    spans = F.concat_ws(" ", "opened", F.slice("w", F.col("at") + 2, F.size("w")))
    spans = F.when(F.col("opened") != "", F.coalesce(F.nullif(part(spans, QUOTED_WORD, 2), F.lit("")), F.expr("substring(opened, 2)"))).otherwise("")
    whole = F.concat(every(ESCAPED, 3), every(QUOTED, 3), every(PLAIN, 2), every(LOGIN, 1), F.array(spans))
    runs, gaps = every(RUN, 0), F.split("word", RUN, -1)
    # What stands before a run: the run before it, or the words before, and the characters between.
    leads = F.zip_with(F.concat(F.array(head), runs), gaps, lambda x, y: F.concat(x, y))
    parts = F.flatten(F.transform(every(JWT, 0), lambda t: F.split(t, r"\.")))
    kept = ["id", "at", *context, "follows", "follows_given"]
    found = found.select(*kept, parts.alias("parts"), runs.alias("runs"), leads.alias("leads"), F.array_distinct(F.filter(whole, lambda v: v != "")).alias("whole"))
    one = lambda v, given: F.struct(v.alias("value"), given.alias("given"))
    given = F.zip_with("runs", "leads", lambda v, lead: one(v, F.rlike(lead, F.lit(GIVEN)) | F.array_contains("whole", v) | (F.col("follows_given") & (v == F.col("follows")))))
    after = F.filter(F.array("follows"), lambda v: (v != "") & ~F.array_contains("runs", v) & ~F.array_contains("whole", v))
    listed = F.concat(F.filter(given, lambda x: x["value"].isNotNull()), F.transform(F.array_except("whole", "runs"), lambda v: one(v, F.lit(True))), F.transform(after, lambda v: one(v, F.col("follows_given"))))
    found = found.select("id", "at", *context, "parts", F.posexplode(listed).alias("place", "one"))
    return found.select("id", "at", "place", "one.value", *context, "one.given", F.array_contains("parts", F.col("one.value")).alias("part"))


def dictionary(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> list[str]:
    """The most frequent words of 3 to 12 small letters; ties in order of letters."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+")).alias("w")).where(F.rlike("w", F.lit("^[a-z]{3,12}$")))
    counted = words.groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(most)
    return [r["w"] for r in counted.collect()]


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """found with the columns FEATURES."""
    value, size = F.col("value"), F.length("value")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    known = "|".join(sorted(map(re.escape, words), key=lambda w: (-len(w), w))) or "(?!)"
    columns = {
        "length": F.log2(size),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "signs": share("[^A-Za-z0-9]"),
        **{name: share(pattern) for name, pattern in TRANSITIONS.items()},
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "vowels": share("[aeiouAEIOU]"),
        "hex": F.rlike(value, F.lit("^[0-9a-fA-F]+$")),
        "covered": F.lit(1.0) - F.length(F.regexp_replace(F.lower(value), known, "")) / size,
    }
    columns |= {k: F.col(k) for k in FEATURES if k not in columns}
    return found.withColumns({k: c.cast("double") for k, c in columns.items()})


def labelled_by_rule(found: DataFrame) -> DataFrame:
    """id, at, place, label of the candidates whose form settles them. Known key forms, parts of web tokens, and values that
    are assigned to a credential word are secrets (1), the latter if they have a digit and MIN_LENGTH characters, or a digit,
    a letter and SURE_LENGTH. Not secrets (0) are numbers alone and what has no digit; of short assigned values, only small letters are."""
    value, given = F.col("value"), F.col("given")
    digit, spaced, long = F.rlike(value, F.lit("[0-9]")), F.rlike(value, F.lit(r"\s")), F.rlike(value, F.lit(f"^{RUN}$"))
    keyed = F.rlike(value, F.lit("^(AKIA|ASIA)[A-Z0-9]{16}$")) | F.rlike(value, F.lit("^(ghp|gho|sk|pk|xox[bp])[_-][A-Za-z0-9]{16,}"))
    named = given & digit & ~spaced & ((F.length(value) >= MIN_LENGTH) | (F.rlike(value, F.lit("[A-Za-z]")) & (F.length(value) >= SURE_LENGTH)))
    plain = (~given | long) & (~digit | F.rlike(value, F.lit("^[0-9+_/-]+$"))) | F.rlike(value, F.lit("^[A-Za-z]?[a-z]*$"))
    label = F.when(keyed | named | F.col("part"), 1.0).when(plain, 0.0)
    return found.select("id", "at", "place", label.alias("label")).where("label is not null")


#: Texts made with a secret (1) or a look-alike (0); {hex}, {key}, {upper}, {short} and {number} stand for made-up values, the one after "!" is labelled.
MADE = [
    (1, "export AWS_SECRET_ACCESS_KEY=!{key}40 before the run"), (1, "found !AKIA{upper}16 in the log"), (1, "remote uses !ghp_{key}36 for pulls"), (1, 'set password = "!{short}10" in the file'),
    (1, "connect to postgres://app:!{short}12@db.example.org/main at night"), (1, 'body {{"api_key":"!{hex}32","n":3}} was sent'), (1, "header Authorization: Bearer !{key}64 expires soon"), (1, "the secret token is !{hex}40 for now"),
    (1, "client_secret: !{key}24"), (1, "signing key material !{key}44"), (1, "auth_token=!{hex}24&user=bob"), (1, "db_passwd='!{short}9' # old"),
    (0, "commit !{hex}40 fixed the build"), (0, "checksum of the archive is !{hex}32 as listed"), (0, "see /usr/share/doc/!some-long-path-name-{number}4/readme for more"), (0, "https://example.org/articles/!what-we-learned-from-{number}5-runs online"),
    (0, "the word !internationalization is long"), (0, "order number !{number}16 was shipped"), (0, "reset your password !instructions follow by mail"), (0, "the token !economy grew in the city"),
    (0, "image data !iVBORw0KGgo{key}60 was inlined"), (0, "request !{hex}32 took long"), (0, "call +49 !{number}17 for help"), (0, "class !navigation-header-collapsed-item is set"), (0, "revision !{hex}20 and build {number}6"), (0, "auth !failed for the third time"),
]


def planted(docs: DataFrame, each: int = TRAIN_FINDINGS // 10) -> tuple[DataFrame, DataFrame]:
    """(id, text), (id, label, value): `each` texts of every kind of MADE with other values, and what is planted in them. Values come from hashes of
    the texts' numbers, so every run makes the same. Ids are below zero."""
    forms = [(i, label, text) for i, (label, text) in enumerate(MADE)]
    rows = docs.sparkSession.range(len(forms) * each).select((-F.col("id") - 1).alias("id"), (F.col("id") % len(forms)).cast("int").alias("form"))
    digest = lambda k: F.sha2(F.concat_ws(":", F.lit(str(k)), F.col("id").cast("string")), 512)
    base = lambda k: F.regexp_replace(F.base64(F.unhex(digest(k))), "[+/=]", "")
    made = {
        "hex": digest(1),
        "key": base(2),
        "upper": F.translate(F.upper(base(3)), "0189", "ABCD"),
        "short": F.concat(F.substring(base(4), 1, 4), F.element_at(F.split(F.lit("& ! $ ~ . @ % ?"), " "), (F.pmod(F.hash("id"), F.lit(8)) + 1).cast("int")), F.substring(F.conv(F.substring(digest(5), 1, 12), 16, 10), 1, 3), F.substring(base(6), 1, 8)),
        "number": F.concat(F.conv(F.substring(digest(7), 1, 12), 16, 10), F.conv(F.substring(digest(8), 1, 12), 16, 10)),
    }
    texts, values, labels = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for i, label, text in forms:
        parts, value, taken = [], [], False
        for piece in re.split(r"(\{\w+\}\d+)", text.replace("{{", "\0").replace("}}", "\1")):
            field_of = re.fullmatch(r"\{(\w+)\}(\d+)", piece)
            before, mark, plain = piece.partition("!")
            plain = plain if mark else before
            plain = plain.replace("\0", "{").replace("\1", "}")
            if mark:
                parts.append(F.lit(before.replace("\0", "{").replace("\1", "}")))
                taken = True
            column = F.substring(made[field_of[1]], 1, int(field_of[2])) if field_of else F.lit(plain)
            parts.append(column)
            if taken is True and (field_of or plain):
                if field_of:
                    value.append(column)
                else:
                    head = re.match(r"""[^\s"'&@#]*""", plain)[0]
                    value.append(F.lit(head))
                    taken = len(head) == len(plain)
        at = F.col("form") == i
        texts, values, labels = F.when(at, F.concat(*parts)).otherwise(texts), F.when(at, F.concat(*value)).otherwise(values), F.when(at, F.lit(float(label))).otherwise(labels)
    out = rows.select("id", "form", texts.alias("text"), labels.alias("label"), values.alias("value"))
    return out.select("id", "text"), out.select("id", "label", "value")


def labelled_rows(featured: DataFrame, findings: DataFrame, most: int = TRAIN_FINDINGS) -> DataFrame:
    """label and FEATURES of the labelled findings (id, at, place, label), at most so many of each label: those with the smallest hashes."""
    known = findings.select(F.col("id").alias("f_id"), F.col("at").alias("f_at"), F.col("place").alias("f_place"), F.col("label").cast("double").alias("label")).where("label in (0, 1)")
    rows = featured.join(known, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("at") == F.col("f_at")) & (F.col("place") == F.col("f_place")))
    order = [F.xxhash64("value", "id", "at", "place"), "value", "id", "at", "place"]
    return rows.where("label = 1").orderBy(*order).limit(most).unionByName(rows.where("label = 0").orderBy(*order).limit(most)).select("label", *FEATURES)


def planted_rows(docs: DataFrame, words: list[str], each: int = TRAIN_FINDINGS // 10) -> DataFrame:
    """id, label and FEATURES of what is planted in made-up texts, where it is a candidate. words: the dictionary."""
    texts, labels = planted(docs, each)
    featured = features(candidates(texts, "id"), words).alias("f")
    met = featured.join(labels.alias("l"), (F.col("f.id") == F.col("l.id")) & (F.col("f.value") == F.col("l.value")))
    return met.select("f.id", "l.label", *[f"f.{c}" for c in FEATURES])


def fit(rows: DataFrame):
    """A forest (or the only label) from rows of label and FEATURES."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = stored(rows, "findings")
    labels = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(labels) < 2:
        return labels[0] if labels else 0.0
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.orderBy("label", *FEATURES).coalesce(1))
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(assembled)


def judged(featured: DataFrame, model) -> DataFrame:
    """featured with score, the share of the forest that takes a candidate for a secret."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if isinstance(model, float):
        return featured.withColumn("score", F.lit(model))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.5) -> DataFrame:
    """id, at, place, value, score, is_secret of every candidate; is_secret is false for what the forest removes."""
    found = stored(candidates(docs, id_col, text_col), "candidates")
    words = dictionary(docs, text_col)
    featured = features(found, words)
    rows = labelled_rows(featured, labelled_by_rule(found) if findings is None else findings)
    if findings is None:
        rows = rows.unionByName(planted_rows(docs, words).drop("id"))
    return judged(featured, fit(rows)).select("id", "at", "place", "value", "score", (F.col("score") >= keep).alias("is_secret"))


def redacted(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the secrets of each text replaced by a mark, longer ones first: one may hold another. Values of under
    MIN_LENGTH characters are replaced where no key character stands beside them."""
    values = scanned.where("is_secret").groupBy(F.col("id").alias("s_id")).agg(F.collect_set("value").alias("values_"))
    joined = docs.join(values, F.col(id_col).eqNullSafe(F.col("s_id")), "left").drop("s_id")
    exact = lambda v: F.concat(F.lit(r"\Q"), F.replace(F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E"))
    bounded = lambda v: F.concat(F.lit("(?<![A-Za-z0-9+/_-])"), exact(v), F.lit("(?![A-Za-z0-9+/_-])"))
    longest = F.array_sort("values_", lambda x, y: F.length(y) - F.length(x))
    pattern = F.array_join(F.transform(longest, lambda v: F.when(F.length(v) >= MIN_LENGTH, exact(v)).otherwise(bounded(v))), "|")
    quoted = mark.replace("\\", "\\\\").replace("$", "\\$")
    return joined.withColumn(text_col, F.when(F.col("values_").isNull(), F.col(text_col)).otherwise(F.regexp_replace(F.col(text_col), pattern, F.lit(quoted)))).drop("values_")
