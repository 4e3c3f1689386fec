"""Personal data: patterns, and information-theoretic sanitisation around them.

Everything is DataFrame functions.  Patterns find addresses and numbers, the
protected entities.  A term of a document with an entity reveals it as far as the corpus
says that who reads the term expects the entity:

    PMI(term; entity) = log2( p(term, entity) / (p(term) p(entity)) )

over whole documents, against the entity's information IC = -log2 p(entity).  Terms whose
PMI is at least ``disclosure`` of the IC are spans too, wherever a document with the entity
has them: removed if no document has them
without the entity, else generalised to the class of word that they are.

How sure the PMI must be depends on what else ties term and entity.  A term spelled like
the name part of an address (one begins with the other, or the part contains the
term) is *related*: the estimate itself counts, smoothed by ``smoothing`` documents
with the entity's overall share, so names of entities of one document go too.  Any other
term needs repeated evidence: the lower bound (Wilson's, of ``SURE`` standard errors) of
p(entity | term) takes the estimate's place, and it must be a half or more.  Copies of
one document are no repetition: documents count by their distinct min-hashes of word
triples, as the effective number (sum n)^2 / sum n^2, so a word of one document,
however often copied, isn't taken for personal data, whatever the size of the corpus.

The patterns use possessive quantifiers and look-behinds that change no match but
keep long runs of one character linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_once
from .common import whole_text, with_row_number_ids

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Share of the entity's information, documents added to a term's.
DISCLOSURE, SMOOTHING = 0.9, 0.5
#: Standard errors of the lower bound, least chance of the entity given the term.
SURE, LIKELY = 1.96, 0.5
#: Fewest joint documents whose lower bound can be ``LIKELY``: n / (n + SURE^2) at best.
_FEWEST = 4
#: Letters that a related term shares with a name part.
_STEM = 3

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM_PATTERN = r"[\p{L}\p{N}]{3,}+"
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)  # a doubled digit's own digits added


def _may_have(kind: str, text: Column) -> Column:
    """A cheap test that every text with such a match passes."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "ip":
        return F.contains(text, F.lit(".")) & text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    return text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")


def may_have_any(text: Column) -> Column:
    test = _may_have(KINDS[0], text)
    for kind in KINDS[1:]:
        test = test | _may_have(kind, text)
    return test


def _luhn(digits: Column) -> Column:
    """Whether digits (at most 19) pass Luhn's test."""
    def value(d: Column, i: Column) -> Column:
        own = d.cast("int")
        twice = F.element_at(F.array(*map(F.lit, _DOUBLED)), own + 1)
        return F.when((F.length(digits) - i) % 2 == 0, twice).otherwise(own)

    each = F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(
        "^(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    return (F.when(kind == "email", True).when(kind == "ip", small)
            .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
            .otherwise(n.between(10, 15)))


def _matches(rows: DataFrame) -> DataFrame:
    """``row, doc_id, kind, pos, gap, hit`` from ``row, doc_id, text``: every match
    with the length of the text before it (from the last match of its kind); a row
    without matches has one line of nulls."""
    text = F.col("text")
    found = F.array(*(F.when(_may_have(k, text), F.struct(
        F.lit(k).alias("kind"), F.split(text, PATTERNS[k], -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)).alias("hits"))) for k in KINDS))
    by_kind = rows.select("row", "doc_id", F.explode_outer(
        F.filter(found, lambda x: F.size(x["hits"]) > 0)).alias("f"))
    cells = by_kind.select("row", "doc_id", F.col("f.kind").alias("kind"), F.posexplode_outer(F.arrays_zip(
        F.col("f.gaps").alias("gap"), F.col("f.hits").alias("hit"))).alias("pos", "z"))
    return cells.filter("kind IS NULL OR z.hit IS NOT NULL").select(
        "row", "doc_id", "kind", "pos", F.length("z.gap").alias("gap"), F.col("z.hit").alias("hit"))


def _base_spans(cells: DataFrame) -> DataFrame:
    """Adds ``start, end`` (code points) and keeps the valid matches and the lines
    of rows without any."""
    so_far = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.col("gap") + F.length("hit")).over(so_far)
    placed = cells.repartition("row").withColumn("end", ends).withColumn("start", F.col("end") - F.length("hit"))
    return placed.withColumn("valid", F.coalesce(_valid(F.col("kind"), F.col("hit")), F.lit(False)))


def _terms(text: Column) -> Column:
    """Distinct lower-cased terms."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM_PATTERN), F.lit(0)), F.lower))


def _holders(spans: DataFrame) -> DataFrame:
    """``row, hit, entity`` (a struct), distinct.  Entities of the same documents, which
    have the same terms, count as one: their number of documents and two hashes."""
    each = spans.filter("valid").select("row", F.lower("hit").alias("hit")).distinct()
    sets = each.groupBy("hit").agg(F.struct(
        F.count("*").alias("documents"), F.bit_xor(F.xxhash64("row")).alias("a"),
        F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b")).alias("entity"))
    return each.join(sets, "hit").select("row", "hit", "entity")


def _document_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``term, df`` over all documents."""
    return docs.select(F.explode(_terms(whole_text(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _min_hash(text: Column) -> Column:
    """The least hash of the text's word triples (of its words, if it has fewer)."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]++"), lambda w: w != "")
    n = F.size(words)
    triples = F.transform(F.arrays_zip(words.alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c")),
                          lambda z: F.xxhash64(z["a"], z["b"], z["c"]))
    return F.array_min(F.when(n >= 3, F.slice(triples, 1, n - 2)).otherwise(triples))


def _related(texts_terms: DataFrame, holders: DataFrame) -> DataFrame:
    """``row, entity, term, df`` of the row's terms that are spelled like a name part
    of an address of the row.  Terms and parts meet at three letters of theirs,
    so a row's terms don't all meet all its addresses."""
    parts = (holders.filter(F.contains("hit", F.lit("@")))
             .select("row", "entity", F.explode(F.array_distinct(F.regexp_extract_all(
                 F.substring_index("hit", "@", 1), F.lit(r"[a-z]{3,}+"), F.lit(0)))).alias("part"))
             .select("row", "entity", "part", F.explode(F.array_distinct(F.transform(
                 F.sequence(F.lit(1), F.length("part") - _STEM + 1),
                 lambda i: F.substr(F.col("part"), i, F.lit(_STEM))))).alias("stem")))
    met = texts_terms.withColumn("stem", F.substring("term", 1, _STEM)).join(parts, ["row", "stem"])
    return met.filter(F.col("term").startswith(F.col("part")) | F.contains("part", F.col("term"))).select(
        "row", "entity", "term", "df").distinct()


def revealing_terms(texts: DataFrame, holders: DataFrame, docs: DataFrame, text_col: str = "text",
                    disclosure: float = DISCLOSURE, smoothing: float = SMOOTHING) -> DataFrame:
    """``row, term, entirely`` of the terms over the threshold for an entity of their
    row (``row, text`` and ``row, hit, entity``)."""
    n = F.lit(docs.count()).cast("double")
    share, spread = F.col("entity.documents") / n, SURE**2
    threshold = disclosure * F.log2(1 / share)
    # terms of more documents than any entity of this table can explain are no use and meet nothing
    useful = holders.agg(F.max(F.greatest(
        F.col("entity.documents") / LIKELY, (F.col("entity.documents") + smoothing * share) / share / F.pow(1 / share, F.lit(disclosure))))).first()[0]
    own = write_once(texts.join(holders.select("row").distinct(), "row", "left_semi").select(
        "row", F.explode(_terms(F.col("text"))).alias("term"))
        .join(_document_counts(docs, text_col).filter(F.col("df") <= (useful or 0.0) + 1), "term"), "pii-own-terms")

    def near(joint: Column) -> Column:
        """Whether the smoothed PMI of a related term is over the threshold."""
        pmi = F.log2((joint + smoothing * share) / (F.col("df") + smoothing) / share)
        return (share < 1) & (pmi >= threshold)

    def sure(joint: Column, documents: Column) -> Column:
        """Whether the PMI's lower bound is, for a rate of joint / df seen in so many documents."""
        rate = joint / F.col("df")
        low = ((rate + spread / (2 * documents) - SURE * F.sqrt(rate * (1 - rate) / documents + spread / (4 * documents**2)))
               / (1 + spread / documents))
        return (share < 1) & (low >= LIKELY) & (F.log2(low / share) >= threshold)

    # no more documents can be joint than have the entity or the term, nor be independent than have the term
    most = F.least("df", "entity.documents")
    frequent = holders.filter(F.col("entity.documents") >= _FEWEST).select("row", "entity").distinct()
    hashes = texts.join(frequent.select("row").distinct(), "row", "left_semi").select("row", _min_hash(F.col("text")).alias("copy"))
    other = own.join(frequent.join(hashes, "row"), "row").filter(sure(most, F.col("df"))).select(
        "row", "entity", "term", "df", "copy", F.lit(False).alias("related"))
    alike = _related(own, holders).filter(near(most)).select(
        "row", "entity", "term", "df", F.lit(None).cast("long").alias("copy"), F.lit(True).alias("related"))
    pairs = write_once(other.unionByName(alike), "pii-pairs")
    # two steps, so that no task counts all documents of a hot entity
    by_copy = pairs.groupBy("entity", "term", "related", "copy").agg(F.count("*").alias("n"), F.max("df").alias("df"))
    counted = by_copy.groupBy("entity", "term", "related").agg(
        F.sum("n").alias("joint"), F.max("df").alias("df"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    joint = F.col("joint")
    independent = F.col("df") / joint * (joint * joint / F.col("squares"))
    risky = counted.filter(F.when(F.col("related"), near(joint)).otherwise(sure(joint, independent))).select(
        "entity", "term", "related", (joint >= F.col("df")).alias("entirely"))
    return pairs.join(risky, ["entity", "term", "related"]).groupBy("row", "term").agg(F.max("entirely").alias("entirely"))


def _occurrences(texts: DataFrame, revealed: DataFrame) -> DataFrame:
    """``row, start, end, term, entirely`` of every occurrence of a row's terms."""
    text = F.col("text")
    cells = texts.join(revealed.select("row").distinct(), "row", "left_semi").select("row", F.posexplode(F.arrays_zip(
        F.split(text, _TERM_PATTERN, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(_TERM_PATTERN), F.lit(0)).alias("hit"))).alias("pos", "z")).filter("z.hit IS NOT NULL")
    lengths = cells.select("row", "pos", F.length("z.gap").alias("gap"), F.length("z.hit").alias("size"), F.lower("z.hit").alias("term"))
    so_far = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = lengths.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    return placed.join(revealed, ["row", "term"]).select(
        "row", (F.col("end") - F.col("size")).alias("start"), "end", "term", "entirely")


def find(rows: DataFrame, docs: DataFrame, text_col: str = "text",
         disclosure: float = DISCLOSURE, smoothing: float = SMOOTHING) -> DataFrame:
    """``row, doc_id, kind, start, end, term, entirely``: the base spans and the
    added ones of ``rows`` (``row, doc_id, text``), and a line with a null kind for
    each row without base matches.  Counts come from all of ``docs``; ``rows`` is read
    several times, so its numbers must be stored."""
    spans = write_once(_base_spans(write_once(_matches(rows), "pii-matches")), "pii-spans")
    texts, holders = rows.select("row", "text"), write_once(_holders(spans), "pii-holders")  # read several times
    revealed = write_once(revealing_terms(texts, holders, docs, text_col, disclosure, smoothing), "pii-terms")
    added = _occurrences(texts, revealed)
    base = spans.select("row", "doc_id", F.when(F.col("valid"), F.col("kind")).alias("kind"),
                        F.when(F.col("valid"), F.col("start")).alias("start"), F.when(F.col("valid"), F.col("end")).alias("end"))
    both = base.withColumns({"term": F.lit(None).cast("string"), "entirely": F.lit(None).cast("boolean")}).unionByName(
        added.withColumns({"doc_id": F.lit(None).cast(base.schema["doc_id"].dataType), "kind": F.lit(TERM)}))
    # added spans that overlap a base span go
    # frames from the first row on are running values; one up to the last row is redone for every row
    by_start, by_last = Window.partitionBy("row").orderBy("start"), Window.partitionBy("row").orderBy(F.desc("start"))
    is_base = F.col("kind") != TERM
    before = F.max(F.when(is_base, F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(is_base, F.col("start"))).over(by_last.rangeBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return (both.withColumn("__free", free).filter("kind IS NULL OR kind <> 'term' OR __free").drop("__free"))


def _listed(only_base: bool) -> Column:
    order = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate((*KINDS, TERM)) for x in (k, i))), F.col("kind"))
    told = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    wanted = F.col("kind").isNotNull() & ((F.col("kind") != TERM) if only_base else F.lit(True))
    one = F.when(wanted, F.struct(F.col("start").alias("s"), order.alias("o"), F.col("end").alias("e"), told.alias("t")))
    return F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["t"]), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           disclosure: float = DISCLOSURE, smoothing: float = SMOOTHING) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the counts ``n_email, n_ip, n_card,
    n_phone``, ``base_spans`` and ``spans`` (``kind:start:end`` by start, then
    kind, comma-joined; code points, end exclusive).

    Null counts as empty; a text without personal data has empty lists.
    Repeated rows have a row each and count as documents each.  An empty table
    gives no rows; other columns are not read."""
    text = whole_text(text_col)
    rows = write_once(with_row_number_ids(docs.select(
        F.col(id_col).alias("doc_id"), F.when(may_have_any(text), text).otherwise("").alias("text")), "row"), "pii-texts")
    spans = find(rows, docs, text_col, disclosure, smoothing)
    return (spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS),
        _listed(True).alias("base_spans"), _listed(False).alias("spans")).drop("row"))


def sanitise(docs: DataFrame, text_col: str = "text", size_col: str | None = None,
             disclosure: float = DISCLOSURE, smoothing: float = SMOOTHING) -> DataFrame:
    """``docs`` with all columns, personal data in the text replaced by its kind
    and revealing terms by their class or nothing; ``size_col``, if given, is set to
    the new text's code points.  Texts without matches, and null ones, stay as they
    are and are not moved."""
    text = whole_text(text_col)
    hit = may_have_any(text)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    stored = write_once(with_row_number_ids(
        docs.filter(hit).select(row.alias("__doc"), text.alias("text")), "row"), "pii-hits")
    spans = find(stored.select("row", F.lit(None).cast("long").alias("doc_id"), "text"), docs, text_col, disclosure, smoothing)
    label = (F.when(F.col("kind") != TERM, F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
             .when(F.col("entirely"), "").when(F.col("term").rlike("^[0-9]+$"), "[NUMBER]").otherwise("[WORD]"))
    # overlapping spans become one, under the first one's label
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    last = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = (spans.filter("kind IS NOT NULL").withColumn("label", label)
             .withColumn("__new", (F.coalesce(last, F.lit(-1)) <= F.col("start")).cast("int"))
             .withColumn("__group", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    merged = apart.groupBy("row", "__group").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("label", F.struct("start", -F.col("end"), "kind")).alias("label"))
    listed = merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("__spans"))
    whole = stored.join(listed, "row", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string>>")
    with_ends = whole.withColumn("__spans", F.coalesce("__spans", none)).withColumn(
        "__from", F.concat(F.array(F.lit(0).cast("long")), F.transform("__spans", lambda x: x["end"])))
    pieces = F.transform(F.arrays_zip(F.col("__from").alias("a"), F.col("__spans").alias("s")), lambda z: F.concat(
        F.substr(F.col("text"), (z["a"] + 1).cast("int"),
                 F.coalesce(z["s"]["start"] - z["a"], F.length("text")).cast("int")),
        F.coalesce(z["s"]["label"], F.lit(""))))
    new = with_ends.withColumn("__new", F.array_join(pieces, ""))
    changed = F.size("__spans") > 0
    out = []
    for f in docs.schema.fields:
        own = F.col(f"__doc.`{f.name}`")
        if f.name == text_col:
            own = F.when(changed, F.col("__new")).otherwise(own)
        elif f.name == size_col:
            own = F.when(changed, F.length("__new").cast(f.dataType)).otherwise(own)
        out.append(own.alias(f.name))
    return docs.filter(~hit).unionByName(new.select(*out))
