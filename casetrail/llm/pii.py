"""Information-theoretic sanitisation of personal data.

Protected entities are e-mail addresses, IP addresses, payment cards and phone numbers found by pattern. Words that stand in
the same documents as an entity may reveal it after it is gone, wherever in a document they stand. The corpus tells how
strongly: with the information content ``IC(e) = -log(documents with e / documents)``, a term discloses the share

    PMI(e, t) / IC(e) = 1 + log P(e | t) / IC(e)

of it. ``P(e | t)`` is estimated in two ways, of which the larger counts:

    own    = (documents with e and t / documents with t) * (k - 1) / (k - 1 + DOUBT)
    class  = (documents with c and t / documents with t) * (k - 1) / (k - 1 + DOUBT) * documents with e / documents with c

``k`` is the number of different texts with both, so copies of one text prove nothing and few texts prove little. ``c`` is the
class of the entity (the domain of an address, the first three numbers of an IP address, the first six digits of a card or phone
number), through which a term can disclose an entity that is met only once. A term that reaches ``GENERALISE`` is generalised, one
that reaches ``REMOVE`` removed, at every place in every document that holds the entity.

Places come from the lengths of what a pattern splits a text into, summed by a window over one text's matches. Repetitions
in the patterns are possessive and start at the begin of a run of their characters, so that long runs neither take square
time nor a deep stack; they match what the plain patterns match. Only DataFrame operations run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.llm.rows import anchored, col, join_counted, placed, unpacked
from casetrail.session import broadcast_if_small, stash

KINDS = ["email", "ip", "card", "phone"]
ADDED = ["remove", "generalise"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MUST_HAVE = {"email": "@", "ip": ".", "card": "", "phone": "+"}
DOUBT = 1.0
"""How many texts' worth of doubt stand against what is seen."""
GENERALISE, REMOVE = 0.6, 0.85
MOST_TERMS = 200_000
WORD = r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?"
"""What stands between spaces, without marks at its ends."""


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits fits."""
    def value(i: Column) -> Column:
        x = F.substring(F.reverse(digits), i, F.lit(1)).try_cast("int")
        return F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def holds(kind: Column, text: Column) -> Column:
    """Whether a match of a pattern is an entity of its kind."""
    digits = _digits(text)

    def small(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+", "")
        return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)

    card = F.length(digits).between(14, 19)
    return (F.when(kind == "email", True)
            .when(kind == "ip", F.forall(F.split(text, "[.]"), small))
            .when(kind == "card", F.when(card, luhn(digits)).otherwise(False))
            .otherwise(F.length(digits).between(10, 15)))


def entity_of(kind: Column, hit: Column) -> Column:
    """The value that a good match stands for, the same for all its spellings."""
    value = F.when(kind == "email", F.lower(hit)).when(kind == "ip", hit).otherwise(_digits(hit))
    return F.concat(kind, F.lit(":"), value)


def class_of(entity: Column) -> Column:
    """The class of an entity; no class is spelt like an entity."""
    kind = F.substring_index(entity, ":", 1)
    return (F.when(kind == "email", F.concat(F.lit("email:@"), F.substring_index(entity, "@", -1)))
            .when(kind == "ip", F.regexp_extract(entity, r"^ip:(?:[0-9]+\.){3}", 0))
            .otherwise(F.regexp_extract(entity, "^[a-z]+:[0-9]{6}", 0)))


def terms(body: Column) -> Column:
    """The different terms of a text: its words of two characters or more, lower-cased."""
    words = F.transform(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def holders(rows: DataFrame) -> DataFrame:
    """The ``rows`` (``file``, ``pos``, ``body``) that hold an entity, with ``kinds``: for each kind that has one, ``kind``, ``hits``
    (all matches) and ``gaps`` (the text between them)."""
    found = []
    for kind, pattern in PATTERNS.items():
        some = F.instr("body", MUST_HAVE[kind]) > 0 if MUST_HAVE[kind] else F.col("body").rlike("[0-9]")
        gaps, hits = F.split("body", pattern, -1), F.regexp_extract_all("body", F.lit(pattern), F.lit(0))
        found.append(F.when(some, F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), hits.alias("hits"))))
    kinds = F.filter(F.array(*found), lambda k: F.exists(k["hits"], lambda h: holds(k["kind"], h)))
    # the generator of one row keeps the filter from being computed a second time below the projection
    each = rows.select("file", "pos", "body", F.explode(F.array(kinds)).alias("kinds"))
    return each.where(F.size("kinds") > 0)


def entities(held: DataFrame) -> DataFrame:
    """``file``, ``pos``, ``kind``, ``start`` and ``end`` (code points, end exclusive) of each entity in ``holders``."""
    kinds = held.select("file", "pos", F.explode("kinds").alias("k"))
    zipped = F.arrays_zip(F.col("k.gaps").alias("gap"), F.col("k.hits").alias("hit"))
    each = kinds.select("file", "pos", "k.kind", F.posexplode(zipped).alias("i", "m")).where("m.hit is not null")
    each = each.select("file", "pos", "kind", "i", F.length("m.gap").alias("skip"), F.length("m.hit").alias("size"),
                       holds(F.col("kind"), F.col("m.hit")).alias("good"))
    so_far = Window.partitionBy("file", "pos", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.withColumn("end", F.sum(F.col("skip") + F.col("size")).over(so_far)).where("good")
    return ends.select("file", "pos", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def met(held: DataFrame) -> DataFrame:
    """``file``, ``pos``, ``entity``, ``digest`` (of the text): the different entities of each of ``holders``."""
    good = F.transform("kinds", lambda k: F.transform(F.filter(k["hits"], lambda h: holds(k["kind"], h)), lambda h: entity_of(k["kind"], h)))
    return held.select("file", "pos", F.md5(F.col("body").cast("binary")).alias("digest"),
                       F.explode(F.array_distinct(F.flatten(good))).alias("entity"))


def keys_of(seen: DataFrame, total: int, doubt: float, generalise: float) -> DataFrame:
    """``entity``, ``key``, ``n``, ``factor``, ``content``, ``least``: what can disclose an entity, itself or its class.

    A term whose share of documents with the key is ``share`` discloses ``1 + log(share * factor) / content`` of the entity;
    ``least`` is the share from which some entity of the key reaches ``generalise``. Keys that no share can lift there are left out,
    so classes of very many documents never meet the terms. ``n`` is the number of documents with the entity.
    """
    def counted(key: str) -> DataFrame:
        """Documents and different texts with each key; a document holds a class once for each of its entities."""
        once = seen.select(key, "digest", "file", "pos")
        once = once.distinct() if key == "class" else once
        by_text = once.groupBy(key, "digest").agg(F.count(F.lit(1)).alias("n"))
        return by_text.groupBy(key).agg(F.sum("n").alias(f"{key}_n"), F.count(F.lit(1)).alias(f"{key}_texts"))

    own = stash(counted("entity").withColumn("class", class_of(F.col("entity"))).where(F.col("entity_n") < total))
    members = own.groupBy("class").agg(F.count(F.lit(1)).alias("members"), F.max("entity_n").alias("top"))
    classes = counted("class").join(members, "class")
    # the share that reaches the limit falls with the documents of the entity; a little less, as the last step decides
    whole = F.lit(float(total))
    least = F.pow(F.col("top") / whole, 1 - generalise) * F.col("all") / F.col("top") * (1 - 1e-6)
    able = least <= (F.col("texts") - 1) / (F.col("texts") - 1 + doubt)
    itself = own.select("entity", F.col("entity").alias("key"), "entity_n", F.col("entity_n").alias("top"), F.col("entity_n").alias("all"),
                        F.col("entity_texts").alias("texts"))
    classes = stash(classes.select("class", "members", "top", F.col("class_n").alias("all"), F.col("class_texts").alias("texts")))
    by_class = join_counted(own, classes, "class", n="members", how="inner").select(
        "entity", F.col("class").alias("key"), "entity_n", "top", "all", "texts")
    return itself.unionByName(by_class).where(able).select(
        "entity", "key", F.col("entity_n").alias("n"), (F.col("entity_n") / F.col("all")).alias("factor"),
        (-F.log(F.col("entity_n") / whole)).alias("content"), least.alias("least"))


def disclosing(known: DataFrame, held: DataFrame, seen: DataFrame, texts: DataFrame, doubt: float) -> DataFrame:
    """``pair`` (key and term), ``n`` (documents with both) and ``share`` of the terms that disclose too much by a key.

    ``known``: landed ``file``, ``pos``, ``keys`` of the documents that hold keys; ``held`` and ``seen``: landed ``holders`` and
    ``met``; ``texts``: ``body`` of every document. A document's terms meet its keys, once for all its copies.
    """
    # one document of each text stands for its copies
    by_text = seen.select("digest", "file", "pos").distinct().groupBy("digest")
    per_text = by_text.agg(F.min(F.struct("file", "pos")).alias("place"), F.count(F.lit(1)).alias("copies"))
    first = per_text.select("place.file", "place.pos", "copies")
    whole = held.select("file", "pos", "body").join(known.join(first, ["file", "pos"]), ["file", "pos"])
    own = whole.select("copies", terms(F.col("body")).alias("terms"), F.array_distinct(F.transform("keys", lambda k: k["key"])).alias("own"))
    # the terms are found below the generators, once for a document and not once for a key
    both = own.select("copies", "terms", F.explode("own").alias("key")).select("key", "copies", F.explode("terms").alias("term"))
    pairs = both.groupBy("key", "term").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("texts"))
    least = known.select(F.explode("keys").alias("k")).groupBy("k.key").agg(F.min("k.least").alias("least"))
    sure = (F.col("texts") - 1) / (F.col("texts") - 1 + doubt)
    pairs = pairs.where("texts > 1").join(least, "key").where(sure >= F.col("least"))
    pairs = stash(pairs.select("key", "term", "n", sure.alias("sure"), "least"))
    if pairs.isEmpty():
        schema = "pair struct<key: string, term: string>, n long, share double"
        return held.sparkSession.createDataFrame([], schema)
    asked = broadcast_if_small(pairs.select("term").distinct(), MOST_TERMS)
    # counted before the join, map-side: occurrences of common terms never become rows of a join. The terms asked for are
    # distinct, so the join is a plain one; a semi join would be moved below the count
    with_term = (texts.select(F.explode(terms(F.col("body"))).alias("term"))
                 .groupBy("term").agg(F.count(F.lit(1)).alias("having")).join(asked, "term"))
    share = F.col("n") / F.col("having") * F.col("sure")
    return pairs.join(with_term, "term").where(share >= F.col("least")).select(
        F.struct("key", "term").alias("pair"), "n", share.alias("share"))


def marked(known: DataFrame, held: DataFrame, told: DataFrame, generalise: float, remove: float) -> DataFrame:
    """``file``, ``pos``, ``kind`` (the action), ``start``, ``end`` of every place at which a term discloses an entity of its document."""
    some = broadcast_if_small(told.select("pair.term").distinct(), MOST_TERMS)
    telling = broadcast_if_small(told.select("pair.key").distinct(), MOST_TERMS)
    keyed = stash(known.select("file", "pos", F.explode("keys").alias("k")).withColumn("key", F.col("k.key")).join(telling, "key", "left_semi"))
    held = held.select("file", "pos", "body").join(keyed.select("file", "pos").distinct(), ["file", "pos"])
    body = F.col("body")
    words = F.arrays_zip(F.split(body, WORD, -1).alias("gap"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("word"))
    each = held.select("file", "pos", F.posexplode(words).alias("i", "m"))
    so_far = Window.partitionBy("file", "pos").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.where("m.word is not null").select(
        "file", "pos", F.lower("m.word").alias("term"), F.length("m.word").alias("size"),
        F.sum(F.length("m.gap") + F.length("m.word")).over(so_far).alias("end"))
    places = each.join(some, "term", "left_semi")
    by_key = places.join(keyed, ["file", "pos"]).select("file", "pos", "size", "end", "k", F.struct("key", "term").alias("pair"))
    by_key = stash(by_key)
    placed_terms = join_counted(by_key, told, "pair", how="inner")
    disclosed = 1 + F.log(F.col("share") * F.col("k.factor")) / F.col("k.content")
    most = placed_terms.groupBy("file", "pos", "size", "end").agg(F.max(disclosed).alias("disclosed")).where(F.col("disclosed") >= generalise - 1e-9)
    action = F.when(F.col("disclosed") >= remove - 1e-9, "remove").otherwise("generalise")
    return most.select("file", "pos", action.alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")


def spans(docs: DataFrame, text: str = "text", doubt: float = DOUBT, generalise: float = GENERALISE,
          remove: float = REMOVE) -> DataFrame:
    """``file``, ``pos``, ``kind``, ``start``, ``end``: entities and the terms that disclose them, in documents (anchored).

    Base kinds may overlap each other; added spans overlap no other span.
    """
    texts = placed(docs, body=F.coalesce(col(text).cast("string"), F.lit(""))).select("file", "pos", "body")
    held = stash(holders(texts))
    base = stash(entities(held))
    seen = stash(met(held).withColumn("class", class_of(F.col("entity"))))
    keys = stash(keys_of(seen, texts.count(), doubt, generalise))
    if keys.isEmpty():
        return base
    of_entity = keys.groupBy("entity").agg(F.first("n").alias("n"), F.collect_list(F.struct("key", "factor", "content", "least")).alias("own"))
    known = join_counted(seen, stash(of_entity), "entity", how="inner").groupBy("file", "pos").agg(F.flatten(F.collect_list("own")).alias("keys"))
    known = stash(known)
    told = stash(disclosing(known, held, seen, texts.select("body"), doubt))
    if told.isEmpty():
        return base
    added = marked(known, held, told, generalise, remove)
    both = base.withColumn("own", F.lit(True)).unionByName(added.withColumn("own", F.lit(False)))
    order = Window.partitionBy("file", "pos").orderBy("start", F.desc("own"), "end")
    before = F.max(F.when(F.col("own"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("own"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    apart = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return both.withColumn("apart", apart).where("own or apart").select(*base.columns)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans`` and its place.

    ``spans`` is ``kind:start:end`` of all spans by start, then kind, joined with commas; ``base_sha256`` is the SHA-256 of
    such a list of the base kinds only. ``how`` are ``doubt``, ``generalise`` and ``remove``. The terms of a document meet its keys
    (entities and classes that stand in two texts at least), so a document costs their product. Null texts count as empty and, like texts without spans, give an empty list. Null ids
    stay null, repeated rows are each looked at. No documents give no rows. Other columns are not looked at.
    """
    docs = anchored(docs)
    kinds = F.array(*[F.lit(k) for k in KINDS + ADDED])
    listed = F.struct("start", F.array_position(kinds, F.col("kind")).alias("k"), "end", "kind")
    grouped = spans(docs, text, **how).groupBy("file", "pos").agg(
        F.array_sort(F.collect_list(listed)).alias("all"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])

    def joined(values: Column) -> Column:
        return F.array_join(F.transform(values, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    rows = placed(docs, doc_id=col(doc_id)).select("file", "pos", "doc_id").join(grouped, ["file", "pos"], "left")
    base = F.coalesce(joined(F.filter("all", lambda s: s["k"] <= len(KINDS))), F.lit(""))
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                       F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"),
                       "file", "pos")


def sanitised(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with entities replaced by their kind, disclosing terms by a class (``[NUMBER]``, ``[NAME]``, ``[WORD]``) or by
    ``[REMOVED]``. Of spans that overlap the first is replaced and the rest of the others goes with it. Null texts stay null,
    repeated rows are each cleaned, all columns are kept, no documents give no rows.
    """
    docs = anchored(docs)
    listed = F.array_sort(F.collect_list(F.struct("start", "end", "kind")))
    grouped = spans(docs, text, **how).groupBy("file", "pos").agg(listed.alias("all"))
    rows = placed(docs, body=col(text).cast("string")).join(grouped, ["file", "pos"], "left")

    def put(done: Column, s: Column) -> Column:
        own = F.substring(F.col("body"), s["start"] + 1, s["end"] - s["start"])
        general = F.when(own.rlike("[0-9]"), "[NUMBER]").when(own.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        mark = F.when(s["kind"] == "remove", "[REMOVED]").when(s["kind"] == "generalise", general).otherwise(
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        between = F.substring(F.col("body"), done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        more = F.when(s["start"] >= done["at"], F.concat(done["parts"], F.array(between, mark))).otherwise(done["parts"])
        return F.struct(F.greatest(done["at"], s["end"]).cast("int").alias("at"), more.alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    spans_ = F.transform("all", lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["kind"].alias("kind")))
    done = F.aggregate(spans_, start, put)
    rows = rows.withColumn("done", done)
    new = F.when(F.col("all").isNull(), F.col("body")).otherwise(
        F.concat(F.array_join("done.parts", ""), F.substring(F.col("body"), F.col("done.at") + 1, F.length("body"))))
    return unpacked(rows.select(F.col("row").withField("`" + text + "`", new).alias("row")))
