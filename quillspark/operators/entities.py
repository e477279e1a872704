"""Entities: grounding of recognised ones, merging over documents, matching of mentions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fields, rules, text as tx
from quillspark.functions.lazy import lazy_udf
from quillspark.operators.components import components
from quillspark.operators.dictionary import occurrences
from quillspark.session import staged

KEY = Window.partitionBy


def clean_list(values: Column) -> Column:
    """Trimmed, non-empty, distinct strings in order; null as none."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(values, tx.strip), lambda v: v != "")), F.array().cast("array<string>"))


def grounded(type_: Column, name: Column, codes: Column, aliases: Column, text: Column, title: Column) -> Column:
    """The recognised entity as struct<type,name,codes,aliases> with only what text and title bear out.

    A name that they do not contain, or an unknown type, makes it a document called title, without codes.
    """
    source = tx.squashed(F.concat(F.coalesce(text, F.lit("")), F.coalesce(title, F.lit(""))))
    found = lambda v: source.contains(tx.squashed(v))
    real = F.coalesce((tx.strip(name) != "") & found(name) & type_.isin(rules.ENTITY_TYPES), F.lit(False))
    kind = F.when(real, type_).otherwise("document")
    own = tx.strip(F.when(real, name).otherwise(title))
    generic = F.array(*map(F.lit, rules.GENERIC))
    fit = lambda a: (a != own) & (F.length(a) >= 2) & ~F.array_contains(generic, F.upper(a)) & ~a.startswith("本") & (found(a) | tx.is_subsequence(a, own) | tx.is_subsequence(a, title))
    kept = F.when(kind == "document", F.array().cast("array<string>")).otherwise(F.filter(clean_list(codes), found))
    return F.struct(kind.alias("type"), own.alias("name"), kept.alias("codes"), F.slice(F.filter(clean_list(aliases), fit), 1, rules.MOST_ALIASES).alias("aliases"))


def linked_parts(docs: DataFrame) -> DataFrame:
    """doc_id and part: documents that share names or codes, however indirectly, share a part.

    Only names and codes are vertices; a name without codes is a part of its own.
    """
    rows = docs.select("doc_id", F.concat(F.lit("n:"), "entity.name").alias("own"), "entity.codes")
    links = rows.select(F.col("own").alias("a"), F.explode(F.transform("codes", lambda c: F.concat(F.lit("c:"), c))).alias("b")).distinct()
    parts, _ = staged(components(links), "entity-parts")
    return rows.join(parts, rows["own"] == parts["vertex"], "left").select("doc_id", F.coalesce("component", "own").alias("part"))


def merge(docs: DataFrame) -> DataFrame:
    """Entities of documents (doc_id, file_name, entity), folded in order of file_name and id.

    A document joins every group that bears its name as the group's first one, or shares a code; groups it connects
    become one with the earliest. Only documents connected by names or codes can meet, so each connected part is
    its own job. A part is one group from its first document on, if each later document has the first one's name or
    a code that an earlier document has: then the order decides nothing but the order of lists, and the part is added
    up by hashed aggregations, however large. Parts where a document begins a second group are folded, one task a part.
    """
    rows = docs.where("entity is not null").select("doc_id", "file_name", "entity.*")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"codes": F.coalesce("codes", none), "aliases": F.coalesce("aliases", none)})
    together, _ = staged(rows.join(linked_parts(docs.where("entity is not null")), "doc_id"), "entity-documents")
    # Of documents with the same name and codes the first one decides: the others have its codes, or like it the first name.
    kinds = together.groupBy("part", "name", "codes").agg(F.min(F.struct("file_name", "doc_id", "type")).alias("k"))
    kinds, _ = staged(kinds.select("part", "name", "codes", "k.*"), "entity-kinds")
    folded, _ = staged(begin_again(kinds), "entity-folds")
    whole = _added_up(*(df.join(folded, "part", "left_anti") for df in (together, kinds)))
    return whole.unionByName(together.join(folded, "part", "left_semi").groupBy("part").applyInPandas(folded_part, fields.ENTITY))


def begin_again(together: DataFrame) -> DataFrame:
    """Parts in which a document other than the first has neither the first one's name nor a code of an earlier document."""
    at = F.struct("file_name", "doc_id", "name", "codes")
    # Documents without codes take no part in the join by code: as nulls they would all be one task's.
    coded = together.select("part", at.alias("at"), F.explode("codes").alias("code")).where("code is not null")
    earliest = coded.groupBy("code").agg(F.min("at").alias("first"))
    linked = coded.join(earliest, "code").where(F.struct("first.file_name", "first.doc_id") < F.struct("at.file_name", "at.doc_id")).select("part", "at").distinct()
    heads = together.groupBy("part").agg(F.min(at).alias("head"))
    others = together.select("part", at.alias("at")).join(heads, "part").where((F.col("at") != F.col("head")) & (F.col("at.name") != F.col("head.name")))
    return others.join(linked, ["part", "at"], "left_anti").select("part").distinct()


def _added_up(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Each part as one entity: name and type of its first document, lists in order of documents and places in them.

    kinds: of each part, name and codes the first document. Values are added up from the first documents of their lists.
    """
    at = F.struct("file_name", "doc_id", "name", "codes", "type")
    heads = kinds.groupBy("part").agg(F.min(at).alias("head"))
    named = rows.groupBy("part", "aliases").agg(F.min(F.struct("file_name", "doc_id")).alias("k")).select("part", "aliases", "k.*")
    listed = lambda df, n, values: df.select("part", "file_name", "doc_id", F.lit(n).alias("list"), F.posexplode(values).alias("i", "value"))
    every = listed(kinds, 0, "codes").unionByName(listed(named, 1, "aliases"))
    once = every.groupBy("part", "list", "value").agg(F.min(F.struct("file_name", "doc_id", "i")).alias("k"))
    # A document is in few rows of a part: they are not added up before they are listed.
    docs = rows.select("part", F.lit(2).alias("list"), F.col("doc_id").alias("value"), F.struct("file_name", "doc_id", F.lit(0).alias("i")).alias("k"))
    lists = once.unionByName(docs).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("list", "k", "value"))).alias("all"))
    of = lambda n: F.array_distinct(F.transform(F.filter("all", lambda x: x["list"] == n), lambda x: x["value"]))
    found = heads.join(lists, "part").select(F.col("head.name").alias("name"), F.col("head.type").alias("type"), *[of(n).alias(c) for n, c in enumerate(("codes", "aliases", "doc_ids"))])
    return found.select(F.coalesce(F.array_min("codes"), "name").alias("id"), "name", "type", "codes", "aliases", "doc_ids")


def folded_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """The groups of one part; names and codes of groups are distinct at any time, so each is looked up."""
    groups: dict[int, dict] = {}
    by_name: dict[str, int] = {}
    by_code: dict[str, int] = {}
    rows = pdf.assign(codes=pdf["codes"].map(tuple)).sort_values(["file_name", "doc_id", "name", "codes"], kind="stable")
    for n, d in enumerate(rows.itertuples()):
        met = sorted({*filter(lambda g: g is not None, map(by_code.get, d.codes)), *([by_name[d.name]] if d.name in by_name else [])})
        if not met:
            groups[n] = {"name": d.name, "type": d.type, "codes": {}, "aliases": {}, "doc_ids": {}}
            by_name[d.name] = n
        at = met[0] if met else n
        home = groups[at]
        absorbed = [groups.pop(g) for g in met[1:]]
        for g in absorbed:
            del by_name[g["name"]]
        for part in [*absorbed, {"codes": d.codes, "aliases": d.aliases, "doc_ids": [d.doc_id]}]:
            by_code |= dict.fromkeys(part["codes"], at)
            for k in ("codes", "aliases", "doc_ids"):
                home[k] |= dict.fromkeys(part[k])
    return pd.DataFrame([{"id": min(g["codes"], default=g["name"]), "name": g["name"], "type": g["type"], **{k: list(g[k]) for k in ("codes", "aliases", "doc_ids")}} for g in groups.values()])


def bare(text: Column) -> Column:
    return F.regexp_replace(text, rules.BOILERPLATE, "")


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring: a candidate length grows while a window of it is in the other text."""
    short, long = sorted((a, b), key=len)
    best = start = 0
    while start + best < len(short):
        if short[start : start + best + 1] in long:
            best += 1
        else:
            start += 1
    return best


@lazy_udf("int")
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_common(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


def labels(entities: DataFrame) -> DataFrame:
    return entities.select("id", "type", F.explode(F.concat(F.array("name"), "aliases")).alias("label"))


def by_code(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention, id) wherever a mention (mention, text: upper-cased) contains one of an entity's codes."""
    codes, _ = staged(entities.select("id", F.explode("codes").alias("c")).select("id", F.upper("c").alias("code")).distinct(), "codes")
    found = occurrences(mentions.select("mention", "text"), "text", codes, "code")
    return found.join(codes, "code").select("mention", "id").distinct()


def by_label(mentions: DataFrame, named: DataFrame, text: str = "text") -> DataFrame:
    """(mention, id) of the longest matches: a label within the text, or the text, of 2 characters at least, within a label."""
    asked, _ = staged(mentions.select("mention", F.col(text).alias("asked")), "asked")
    known, _ = staged(named.select("id", F.upper("label").alias("known")).distinct(), "known")
    labels_ = known.select("known").distinct()
    inside = occurrences(asked, "asked", labels_, "known").join(known, "known").select("mention", "id", F.length("known").alias("n"))
    words = asked.where(F.length("asked") >= 2)
    around = occurrences(labels_, "known", words, "asked").join(known, "known").join(words, "asked").select("mention", "id", F.length("asked").alias("n"))
    met = inside.unionByName(around)
    best = met.groupBy("mention", "id").agg(F.max("n").alias("n"))
    return best.withColumn("top", F.max("n").over(KEY("mention"))).where("n = top").select("mention", "id")


def by_fuzzy(mentions: DataFrame, named: DataFrame, least: int = rules.FUZZY_LEAST) -> DataFrame:
    """(mention, id) of the longest common substrings without boilerplate, of least characters and half the mention at least.

    A mention and a label fit if and only if the label holds a run of that many characters of the mention; labels are
    searched for all such runs at once, so that only pairs that fit are ever made.
    """
    core = F.length("core")
    need = F.greatest(F.lit(least), F.ceil(core / 2).cast("int"))
    left = mentions.withColumn("core", bare(F.col("text"))).where(core >= least).select("mention", "core")
    runs = F.transform(F.sequence(F.lit(1), core - need + 1), lambda i: F.substring("core", i, need))
    left, _ = staged(left.withColumn("run", F.explode(F.array_distinct(runs))), "runs")
    named = named.select("id", bare(F.upper("label")).alias("plain")).where(F.length("plain") >= least).distinct()
    named, _ = staged(named, "plain-labels")
    found, _ = staged(occurrences(named.select("plain").distinct(), "plain", left, "run"), "runs-found")
    pairs = found.join(left, "run").select("mention", "core", "plain").distinct().withColumn("n", common_length("core", "plain"))
    best = pairs.join(named, "plain").groupBy("mention", "id").agg(F.max("n").alias("n"))
    return best.withColumn("top", F.max("n").over(KEY("mention"))).where("n = top").select("mention", "id")


def match(mentions: DataFrame, entities: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(mention, id) of distinct mentions: by code, else label, else label without boilerplate, else, with fuzzy, fuzzily.

    Every step searches texts for codes, labels or runs of characters by an automaton. Generic and empty mentions match nothing.
    """
    rows = mentions.select("mention").distinct().withColumn("text", F.upper(tx.strip(F.col("mention")))).where((F.col("text") != "") & ~F.col("text").isin(rules.GENERIC))
    named = labels(entities)
    core = bare(F.col("text"))
    shorter = lambda left: left.withColumn("core", core).where((F.col("core") != F.col("text")) & (F.length("core") >= 2))
    steps = [
        lambda left: by_code(left, entities),
        lambda left: by_label(left, named),
        lambda left: by_label(shorter(left), named.where("type <> 'document'"), "core"),
        *([lambda left: by_fuzzy(left, named)] if fuzzy else []),
    ]
    left, _ = staged(rows, "mentions")
    found = None
    for step in steps:
        some, _ = staged(step(left), "matches")
        left = left.join(some, "mention", "left_anti")
        found = some if found is None else found.unionByName(some)
    return found


def resolve(requests: DataFrame, entities: DataFrame, fuzzy: bool = True) -> DataFrame:
    """request_id, status, entity_ids, candidate_ids, unknown_mentions of requests (request_id, mentions array).

    confirmed where a mention has one match, else ambiguous where one has several, else unknown, else none. Without fuzzy
    mentions match by codes and labels only.
    """
    rows = requests.select("request_id", F.posexplode_outer("mentions").alias("at", "mention"))
    asked = rows.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mention"))), lambda x: x["mention"]).alias("mentions"))
    return asked.join(resolve_lists(asked.select("mentions"), entities, fuzzy), "mentions").drop("mentions")


def resolve_lists(lists: DataFrame, entities: DataFrame, fuzzy: bool = True) -> DataFrame:
    """mentions, status, entity_ids, candidate_ids, unknown_mentions of the distinct lists of mentions, as resolve has them.

    A name that many requests ask for and many entities share is listed once a list, not once a request: who needs less
    than all its candidates takes that from here before requests are joined.
    """
    rows = lists.select("mentions").distinct().select("mentions", F.posexplode_outer("mentions").alias("at", "mention"))
    every, _ = staged(rows, "lists")
    plain = F.upper(tx.strip(F.col("mention")))
    rows = every.where(F.col("mention").isNotNull() & ~plain.isin(rules.GENERIC))
    hits = match(rows, entities, fuzzy).groupBy("mention").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    rows = rows.join(hits, "mention", "left").withColumn("n", F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")))
    ordered = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("at", value.alias("v"))))), lambda x: x["v"])
    ids = F.col("ids")
    found = rows.groupBy("mentions").agg(
        F.array_distinct(F.flatten(ordered(F.col("n") == 1, ids))).alias("one"), F.array_distinct(F.flatten(ordered(F.col("n") > 1, ids))).alias("many"),
        ordered(F.col("n") == 0, F.col("mention")).alias("unknown_mentions"),
    )
    none = F.array().cast("array<string>")
    found = every.select("mentions").distinct().join(found, "mentions", "left").select("mentions", *[F.coalesce(c, none).alias(c) for c in ("one", "many", "unknown_mentions")])
    status = F.when(F.size("one") > 0, "confirmed").when(F.size("many") > 0, "ambiguous").when(F.size("unknown_mentions") > 0, "unknown").otherwise("none")
    return found.select("mentions", status.alias("status"), F.col("one").alias("entity_ids"), F.when(F.size("one") == 0, F.col("many")).otherwise(none).alias("candidate_ids"), "unknown_mentions")


def pick_option(reply: str, options: list[dict]) -> int | None:
    """Which option (name, aliases) a reply means: an ordinal, else the only one whose label holds or is held by
    its words, else the only one with two neighbouring characters of them."""
    plain = (reply or "").strip()
    if m := re.fullmatch(rules.ORDINAL_REPLY, plain):
        at = rules.ORDINALS[m[1]]
        if at < len(options):
            return at
    core = re.sub(rules.REPLY_NOISE, "", plain)
    if len(core) < 2:
        return None
    names = [[o["name"], *o["aliases"]] for o in options]
    held = [k for k, some in enumerate(names) if any(core in n or n in core for n in some)]
    pairs = {core[i : i + 2] for i in range(len(core) - 1)}
    near = [k for k, some in enumerate(names) if any(p in "".join(some) for p in pairs)]
    return next((found[0] for found in (held, near) if len(found) == 1), None)


@lazy_udf("int")
def picked_option(reply: pd.Series, options: pd.Series) -> pd.Series:
    """pick_option over columns: reply, and an array of struct<name,aliases>."""
    return pd.Series([pick_option(r, [{"name": o["name"], "aliases": list(o["aliases"])} for o in some]) for r, some in zip(reply, options, strict=True)], dtype="Int32")
