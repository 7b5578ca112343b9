"""Personal data: fixed patterns, and terms whose co-occurrence with a protected value gives it away.

Base. Email, IP, card and phone matches, leftmost and non-overlapping per kind; matches that fail their kind's
test are dropped. Each distinct matched value is a protected entity.

Disclosure. Over the N documents of the corpus let k hold entity e, m hold term t, and j hold t near e (the
closest mention before or after t, at most WINDOW words away). The point-wise mutual information log(N j / (k m))
is what t reveals of e, the information content log(N / k) is all there is to reveal. A term that reveals at
least half of it, i.e. N j^2 >= k m^2, and was seen near e in at least SUPPORT documents is sanitised wherever it
stands in any document; one that occurs in no document but near e (j = m) reveals all and is removed, others are
generalised to a placeholder. Left out: terms of values that fewer than SUPPORT documents hold, and values that
are not the closest mention on either side of a word.

Everything is DataFrame functions, and no text is shuffled or written: one pass over the texts takes the words near
values, a second counts in how many texts the candidates stand, a third marks the disclosing ones, each row by itself.
To mark, a text's words are filtered by the set of terms, and a pattern of those left places them. Terms travel by
name (themselves, or a digest where longer than LONGEST bytes). At most NAMES names are part of a plan: of more
candidates, all words are counted map-side and joined by shuffle; of more disclosing terms, each part of them takes a
pass of its own. Rows near values are told apart by (id, hash of the text).

Edge cases: a null text is empty (and stays null when sanitised); an empty text has no spans; rows that repeat
each get the same result; an empty table gives no rows; columns besides the id and the text are ignored by
find() and kept by sanitise(). Patterns are possessive or anchored at the start of a run, so that the time on
very long runs of digits or letters is linear; the matches are those of the plain patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.shared import WORD, materialise, release

KINDS = ("email", "ip", "card", "phone")
#: \G: a match may also begin where the last one of its kind ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
PLACEHOLDER = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>", "gone": ""}

WINDOW = 8
SUPPORT = 3
PUNCTUATION = ".,;:!?()\"'"
BROADCAST_ROWS = 10_000
#: Bytes of a term that travels as itself; names that a plan holds at once.
LONGEST, NAMES = 32, 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"\A(?:{BYTE}\.){{3}}{BYTE}\z")
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15)


def _entity(kind: str, value: Column) -> Column:
    if kind == "email":
        value = F.translate(value, UPPER, LOWER)
    elif kind != "ip":
        value = _digits(value)
    return F.concat(F.lit(f"{kind}:"), value)


def _spans(kind: str, text: Column) -> Column:
    """array<struct<start, rank, kind, end, entity>> of the matches that hold."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind_of = "struct<start:int,rank:int,kind:string,end:int,entity:string>"
    empty = F.array().cast(f"array<{kind_of}>")
    # What lies between matches, with the match after it: positions are running sums of lengths.
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), _entity(kind, pair["match"]).alias("entity"))
        return F.struct(end.alias("at"), F.when(_holds(kind, pair["match"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(F.filter(pairs, lambda p: p["match"].isNotNull()), start, step, lambda acc: acc["spans"])
    needed = text.rlike("[0-9]") if NEEDS[kind] is None else text.contains(NEEDS[kind])
    if kind == "ip":
        needed = text.rlike(r"[0-9]\.[0-9]")
    return F.when(needed, spans).otherwise(empty)


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[_spans(kind, text) for kind in KINDS]))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,entity:string>>")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _core(word: Column) -> Column:
    return F.translate(F.btrim(word, F.lit(PUNCTUATION)), UPPER, LOWER)


def name(word: Column) -> Column:
    """Of the term of a word: without punctuation around it, A-Z lower-cased; a digest of long ones. No word holds a blank."""
    core = _core(word)
    return F.when(F.octet_length(core) <= LONGEST, core).otherwise(F.concat(F.lit(" "), F.md5(core)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def around(text: Column, spans: Column, window: int) -> Column:
    """array<struct<entity, terms>>: names of the words to which each value of the text is the closest before or after,
    at most `window` words away."""
    blank_first, blank_last = r"\A[\x20\x09-\x0D]", r"[\x20\x09-\x0D]\z"
    between = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))
    zero = F.lit(0)

    def near(s: Column, i: Column) -> Column:
        last, following = F.get(spans, i - 1), F.get(spans, i + 1)
        left = between(F.coalesce(last["end"], zero), s["start"])
        right = between(s["end"], F.coalesce(following["start"], F.length(text)))
        # What stands right before the value, in the same word; if that is more than punctuation, the word starts there.
        reaching = F.when(last["end"] > s["start"], between(zero, s["start"])).otherwise(left)
        joined = F.regexp_extract(F.reverse(reaching), r"\A[^\x20\x09-\x0D]*+", 0)
        to_last = F.coalesce((last["end"] <= s["start"]) & (F.length(joined) == F.length(left)), F.lit(False))
        begun = (to_last | (_core(joined) != "")).cast("int")
        whole = F.substring(left, zero + 1, F.greatest(F.length(left) - F.length(joined), zero))
        # Words that touch a value on either side go with it, but count.
        before = F.reverse(_words(F.when(last.isNull() | whole.rlike(blank_first), whole).otherwise(F.regexp_replace(whole, r"\A[^\x20\x09-\x0D]++", ""))))
        after = F.regexp_replace(right, r"\A[^\x20\x09-\x0D]++", "")
        after = _words(F.when(following.isNull() | after.rlike(blank_last), after).otherwise(F.regexp_replace(after, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++\z", "")))
        inside = F.size(_words(between(s["start"], s["end"]))) - begun
        some = lambda words, n: F.slice(words, zero + 1, F.greatest(n, zero))
        terms = F.concat(some(before, F.lit(window) - begun), some(after, F.lit(window) - inside))
        return F.struct(s["entity"].alias("entity"), F.filter(F.transform(terms, name), lambda t: t != "").alias("terms"))

    return F.transform(spans, near)


def contexts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(entity, terms): each value that a text holds, once a text, with the names of the words near it."""
    found = docs.select("id", "tie", base_spans(F.col("text")).alias("spans"), "text").filter(F.size("spans") > 0)
    near = found.select("id", "tie", around(F.col("text"), F.col("spans"), window).alias("near")).dropDuplicates(["id", "tie"])
    mentions = near.select("id", "tie", F.explode("near").alias("n"))
    held = mentions.groupBy("id", "tie", "n.entity").agg(F.array_distinct(F.flatten(F.collect_list("n.terms"))).alias("terms"))
    return held.select("entity", "terms")


def disclosing(docs: DataFrame, seen: DataFrame, used: list, support: int = SUPPORT) -> DataFrame:
    """(entity, term, whole) of the pairs that exceed the threshold, terms by name; whole: the term reveals all. The
    tables that it reads are added to `used`."""
    holders = materialise(seen.groupBy("entity").agg(F.count("*").alias("holders")).filter(F.col("holders") >= support), "holders")
    used.append(holders)
    words = seen.join(_small(holders, holders.count()), "entity").select("entity", "holders", F.explode("terms").alias("term"))
    pairs = materialise(words.groupBy("entity", "holders", "term").agg(F.count("*").alias("joint")).filter(F.col("joint") >= support), "pairs")
    used.append(pairs)
    candidates = pairs.select("term").distinct()
    cores = F.array_distinct(F.transform(F.array_distinct(_words(F.col("text"))), name))
    if candidates.count() <= NAMES:
        names = [r.term for r in candidates.collect()]
        cores = F.filter(cores, lambda t: t.isin(names))
    spread = docs.select(F.explode(cores).alias("term")).groupBy("term").agg(F.count("*").alias("spread"))
    total = docs.agg(F.count("*").alias("total"))  # one row
    j, k, m = (F.col(c).cast("double") for c in ("joint", "holders", "spread"))
    kept = pairs.join(spread, "term").join(F.broadcast(total)).filter(F.col("total").cast("double") * j * j >= k * m * m)
    return kept.select("entity", "term", (F.col("joint") >= F.col("spread")).alias("whole"))


def marks(docs: DataFrame, text: str, gone: dict[str, bool]) -> DataFrame:
    """docs with _tm_terms enlarged by the spans of the words that are terms, named in `gone`, and touch no span of _tm_base."""
    names, whole = list(gone), [n for n in gone if gone[n]]
    hits = F.filter(F.array_distinct(_words(F.col(text))), lambda w: name(w).isin(names))
    quoted = F.transform("_tm_hits", lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit(r"(?<![^\x20\x09-\x0D])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![^\x20\x09-\x0D])"))
    docs = docs.withColumn("_tm_hits", hits).withColumn("_tm_pattern", F.when(F.size("_tm_hits") > 0, pattern))
    # As in _spans: positions are running sums of lengths.
    pairs = F.arrays_zip(F.split(F.col(text), F.col("_tm_pattern"), -1).alias("gap"), F.regexp_extract_all(F.col(text), F.col("_tm_pattern"), F.lit(0)).alias("match"))

    def step(acc: Column, pair: Column) -> Column:
        word, edge = pair["match"], F.lit(PUNCTUATION)
        begin = acc["at"] + F.length(pair["gap"])
        start = begin + F.length(word) - F.length(F.ltrim(word, edge))
        end = start + F.length(F.btrim(word, edge))
        kind = F.when(name(word).isin(whole), "gone").otherwise("term") if whole else F.lit("term")
        span = F.struct(start.alias("start"), F.lit(len(KINDS)).alias("rank"), kind.alias("kind"), end.alias("end"), F.lit(None).cast("string").alias("entity"))
        # Words that touch a base span go with it.
        touched = F.exists("_tm_base", lambda x: (x["start"] < end) & (x["end"] > start))
        return F.struct((begin + F.length(word)).alias("at"), F.when(touched, acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), _none().alias("spans"))
    found = F.aggregate(F.filter(pairs, lambda p: p["match"].isNotNull()), start, step, lambda acc: acc["spans"])
    docs = docs.withColumn("_tm_terms", F.when(F.col("_tm_pattern").isNull(), F.col("_tm_terms")).otherwise(F.concat("_tm_terms", found)))
    return docs.drop("_tm_hits", "_tm_pattern")


def marked(docs: DataFrame, key: str, text: str, window: int = WINDOW, support: int = SUPPORT) -> DataFrame:
    """docs with the columns _tm_base and _tm_terms: base spans, and spans of disclosing terms, of each row."""
    used: list[DataFrame] = []
    plain = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("tie"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seen = materialise(contexts(plain, window), "contexts")
    used.append(seen)
    pairs = materialise(disclosing(plain, seen, used, support), "disclosing")
    used.append(pairs)
    terms = materialise(pairs.groupBy("term").agg(F.max("whole").alias("gone")), "terms")
    used.append(terms)
    parts = -(-terms.count() // NAMES)
    found = docs.select("*", base_spans(F.col(text)).alias("_tm_base"), _none().alias("_tm_terms"))
    for part in range(parts):
        last, found = found, marks(found, text, {r.term: r.gone for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).collect()})
        if part + 1 < parts:
            # Each part of the terms has a plan of its own.
            found = materialise(found, "marked")
            if part:
                release(last)
    release(*used)
    return found


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, support: int = SUPPORT) -> DataFrame:
    """(key, tie, base, terms): base spans, and spans of disclosing terms, of each row."""
    found = marked(docs.select(key, text), key, text, window, support)
    return found.select(key, F.xxhash64(text).alias("tie"), F.col("_tm_base").alias("base"), F.sort_array("_tm_terms").alias("terms"))


def written(spans: Column) -> Column:
    shown = lambda s: F.when(s["kind"] == "gone", "term").otherwise(s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", shown(s), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, in order, replaced by its kind's placeholder; overlapping spans become one."""
    places = F.create_map(*[F.lit(x) for pair in PLACEHOLDER.items() for x in pair])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, places[s["kind"]]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, end))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with the text sanitised; columns, rows and nulls stay."""
    found = marked(docs, key, text, **how)
    clean = redact(F.col(text), F.sort_array(F.concat("_tm_base", "_tm_terms")))
    return found.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def _number(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [_number(kind).alias(f"n_{kind}") for kind in KINDS]
    both = F.sort_array(F.concat("base", "terms"))
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(both).alias("spans"))


_KIND_SQL = r"""SELECT doc_id, text, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM docs"""
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OP1_SQL = (
    r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ("""
    + " UNION ALL ".join(_KIND_SQL.format(rank=i, kind=k, pattern=_PLAIN[k]) for i, k in enumerate(KINDS))
    + r"""),
each AS (SELECT doc_id, rank, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (
  SELECT doc_id, rank, kind, m[i] AS value, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS start,
    regexp_replace(m[i], '[^0-9]', '', 'g') AS digits FROM each
),
tested AS (
  SELECT *, start + length(value) AS stop, CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda x: x::DOUBLE > 255)) = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    ELSE length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda p:
      CASE WHEN p % 2 = 1 THEN substr(digits, (length(digits) - p + 1)::BIGINT, 1)::INT
        WHEN substr(digits, (length(digits) - p + 1)::BIGINT, 1)::INT >= 5 THEN 2 * substr(digits, (length(digits) - p + 1)::BIGINT, 1)::INT - 9
        ELSE 2 * substr(digits, (length(digits) - p + 1)::BIGINT, 1)::INT END)) % 10 = 0 END AS holds FROM placed
),
base AS (
  SELECT doc_id, start, stop, rank, kind, kind || ':' || CASE kind WHEN 'email' THEN translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') WHEN 'ip' THEN value ELSE digits END AS entity
  FROM tested WHERE holds
),
holders AS (SELECT entity, count(DISTINCT doc_id) AS holders FROM base GROUP BY entity HAVING count(DISTINCT doc_id) >= 3),
marks AS (SELECT b.*, h.holders FROM base b LEFT JOIN holders h USING (entity)),
private AS (SELECT DISTINCT doc_id FROM marks WHERE holders IS NOT NULL),
split_up AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split_regex(text, '[^\x20\x09-\x0D]+') AS g FROM docs),
numbered AS (SELECT doc_id, w, g, unnest(range(1, len(w) + 1)) AS i FROM split_up WHERE doc_id IN (SELECT doc_id FROM private)),
stopped AS (SELECT doc_id, w[i] AS word, sum(length(g[i]) + length(w[i])) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM numbered),
words AS (
  SELECT doc_id, translate(trim(word, '.,;:!?()"'''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term,
    (stop - length(ltrim(word, '.,;:!?()"''')))::BIGINT AS start, (stop - length(ltrim(word, '.,;:!?()"''')) + length(trim(word, '.,;:!?()"''')))::BIGINT AS stop FROM stopped
),
lined AS (
  SELECT doc_id, term, start, stop, 1 AS is_word, NULL AS entity, NULL::BIGINT AS holders, 0 AS rank FROM words
  UNION ALL SELECT doc_id, NULL, start, stop, 0, entity, holders, rank FROM marks WHERE doc_id IN (SELECT doc_id FROM private)
),
counted AS (SELECT *, sum(is_word) OVER (PARTITION BY doc_id ORDER BY start, is_word, rank ROWS UNBOUNDED PRECEDING) AS nth FROM lined),
marked AS (SELECT *, CASE WHEN is_word = 0 THEN {'nth': nth, 'start': start, 'stop': stop, 'entity': entity, 'holders': holders} END AS mark FROM counted),
sided AS (
  SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY start, is_word, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
    first_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY start, is_word, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM marked
),
free AS (SELECT * FROM sided WHERE is_word = 1 AND term <> '' AND (before IS NULL OR before.stop <= start) AND (after IS NULL OR after.start >= stop)),
seen AS (
  SELECT doc_id, term, start, stop, before.entity AS entity, before.holders AS holders FROM free WHERE before.holders IS NOT NULL AND nth - before.nth <= 8
  UNION ALL SELECT doc_id, term, start, stop, after.entity, after.holders FROM free WHERE after.holders IS NOT NULL AND after.nth - nth < 8
),
pairs AS (SELECT entity, holders, term, count(DISTINCT doc_id) AS joint FROM seen GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
spread AS (
  SELECT term, count(DISTINCT doc_id) AS spread FROM (SELECT doc_id, translate(trim(unnest(w), '.,;:!?()"'''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM split_up)
  WHERE term IN (SELECT term FROM pairs) GROUP BY term
),
given AS (
  SELECT entity, term FROM pairs JOIN spread USING (term)
  WHERE (SELECT count(*) FROM documents)::DOUBLE * joint * joint >= holders::DOUBLE * spread * spread
),
chosen AS (SELECT DISTINCT term FROM given),
holding AS (
  SELECT DISTINCT doc_id FROM (SELECT doc_id, translate(trim(unnest(w), '.,;:!?()"'''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM split_up)
  WHERE term IN (SELECT term FROM chosen)
),
held AS (SELECT doc_id, w, g, unnest(range(1, len(w) + 1)) AS i FROM split_up WHERE doc_id IN (SELECT doc_id FROM holding)),
ended AS (SELECT doc_id, w[i] AS word, sum(length(g[i]) + length(w[i])) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM held),
hits AS (
  SELECT doc_id, translate(trim(word, '.,;:!?()"'''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term,
    (stop - length(ltrim(word, '.,;:!?()"''')))::BIGINT AS start, (stop - length(ltrim(word, '.,;:!?()"''')) + length(trim(word, '.,;:!?()"''')))::BIGINT AS stop FROM ended
),
terms AS (
  SELECT DISTINCT h.doc_id, h.start, h.stop, 4 AS rank, 'term' AS kind FROM hits h JOIN chosen USING (term)
  WHERE h.term <> '' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.start < h.stop AND b.stop > h.start)
),
spans AS (SELECT doc_id, start, stop, rank, kind FROM base UNION ALL SELECT doc_id, start, stop, rank, kind FROM terms),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN joined j USING (doc_id)
"""
)

QUERIES = {"op1_pii": op1_pii}
ORACLES = {"op1_pii": OP1_SQL}
