"""Tables of searches against a stored index: phrases, conjunctions, ranks, and the best hits of each search.

Everything works on blocks (a term or phrase in a slice of pages). Blocks are first met without their arrays: a slice where one of a
search's phrases is missing holds no hit, and the blocks' bounds add up to the best rank that a page of the slice can have. Arrays are
read for the slices that are left. A search for its best ``depth`` hits looks at its most promising slices first; the ranks
found there are a threshold, and slices that cannot reach it are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from websift.functions import rank as R
from websift.operators import segments as G
from websift.operators.salt import salted_join
from websift.session import stored

PLACE = ["seq", "slice"]
FEW = 64                    # pages of a slice's smallest block at most for the other blocks to be cut down to them
MET = ["sid", "n_phrases", *PLACE, "rare"]      # slices in which a search is evaluated
PHRASE_BLOCKS = ["phrase", "seq", "slice", "n", "ids", "lens", "fs", "peaks"]


def phrase_key(title_only: Column, tokens: Column) -> Column:
    """A phrase's name: equal for equal phrases. Tokens hold no blanks."""
    return F.concat(F.when(title_only, "t ").otherwise("a "), F.array_join(tokens, " "))


def phrase_parts(index: G.Index, phrases: DataFrame) -> DataFrame:
    """``phrase, title_only, n_parts, term, offset``: what to look up for each phrase (``phrase, title_only, tokens``).

    Neighbouring words that are both frequent are looked up as a pair; the other words one by one.
    """
    frequent = G.listed(index.frequent()) or "null"
    known = f"transform(tokens, w -> coalesce(w in ({frequent}), false))"
    # at each place whether it begins a pair; a word goes alone if neither it nor the one before does
    pairs = "transform(sequence(0, size(tokens) - 1), i -> known[i] and coalesce(get(known, i + 1), false))"
    part = """case when pairs[i] then struct(concat(tokens[i], ' ', tokens[i + 1]) as term, i as offset)
                   when i = 0 or not pairs[i - 1] then struct(tokens[i] as term, i as offset) end"""
    each = phrases.withColumn("known", F.expr(known)).withColumn("pairs", F.expr(pairs))
    each = each.select("phrase", "title_only", F.array_compact(F.expr(f"transform(sequence(0, size(tokens) - 1), i -> {part})")).alias("parts"))
    return each.select("phrase", "title_only", F.size("parts").alias("n_parts"), F.explode("parts").alias("p")).select("phrase", "title_only", "n_parts", "p.*")


def _with_few(at: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
    """``at`` with ``few``, the pages of the smallest block of a slice (``rare``, seen by ``name``), if these are FEW at most."""
    pages = blocks.select(F.col(name).alias("rare"), *PLACE, F.when(F.col("n") <= FEW, F.col("ids")).alias("few"))
    return at.join(pages, ["rare", *PLACE], "left").drop("rare")


def _among_few(entries: Column) -> Column:
    """The entries of a block (``doc_id``) that can be hits; others are not sent on."""
    some = F.filter(entries, lambda x: x["doc_id"].isNull() | F.array_contains("few", x["doc_id"]))
    return F.when(F.col("few").isNull(), entries).otherwise(some)


def phrase_blocks(index: G.Index, phrases: DataFrame) -> DataFrame:
    """``PHRASE_BLOCKS``: for each phrase and slice the pages that hold it, in order of id, and how often.

    The blocks of a single word, or of a pair that is indexed, are the index's own. Of other phrases, only slices that hold all
    parts are read, and a page's positions meet in one row for each page that holds the slice's rarest part; what is found is written to
    the shared folder.
    """
    parts, rows = G.held(phrase_parts(index, phrases), "phrase-parts")
    blocks = G.blocks_of(index, parts, rows)
    single = parts.where("n_parts = 1").select("phrase", "title_only", "term")
    at = blocks.select("term", *PLACE, "n", "ids", "lens", "fs", "ts", "peaks").join(single, "term")
    title = F.filter(F.arrays_zip("ids", "lens", "ts"), lambda x: x["ts"] > 0)
    plain = at.where("not title_only").select(*PHRASE_BLOCKS)
    if rows is None or any(r["title_only"] for r in rows):
        plain = plain.unionByName(at.where("title_only").withColumn("e", title).where("size(e) > 0")
                                  .select("phrase", *PLACE, F.size("e").alias("n"), F.col("e.ids").alias("ids"), F.col("e.lens").alias("lens"),
                                          F.col("e.ts").alias("fs"), "peaks"))
    several = parts.where("n_parts > 1")
    if all(r["n_parts"] == 1 for r in rows) if rows is not None else several.isEmpty():
        return plain
    met = blocks.select("term", *PLACE, "n").join(several, "term")
    rare = F.min(F.struct("n", "term"))["term"].alias("rare")
    whole = met.groupBy("phrase", *PLACE).agg(F.count("*").alias("c"), F.first("n_parts").alias("p"), rare).where("c = p").select("phrase", *PLACE, "rare")
    wanted = several.join(_with_few(whole, blocks, "term"), "phrase")
    entry = F.explode(_among_few(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("lens").alias("len"), "pos"))).alias("x")
    each = blocks.select("term", *PLACE, "ids", "lens", "pos").join(wanted, ["term", *PLACE]).select("phrase", "title_only", "n_parts", "offset", *PLACE, entry)
    begins = F.transform("x.pos", lambda k: k - F.col("offset"))
    # a page's parts, and then a slice's pages, meet where phrase and slice have been dealt to
    each = each.select("phrase", "title_only", "n_parts", *PLACE, "x.doc_id", "x.len", begins.alias("begins")).repartition("phrase", *PLACE)
    page = each.groupBy("phrase", "title_only", "n_parts", *PLACE, "doc_id", "len").agg(F.collect_list("begins").alias("begins")).where("size(begins) = n_parts")
    places = F.aggregate(F.slice("begins", 2, F.size("begins")), F.array_distinct(F.col("begins")[0]), lambda a, b: F.array_intersect(a, b))
    f = F.size(F.when(F.col("title_only"), F.filter("places", lambda k: k >= G.TITLE // 2)).otherwise(F.col("places")))
    page = page.withColumn("places", places).withColumn("f", f).where("f > 0")
    found = page.groupBy("phrase", *PLACE).agg(F.sort_array(F.collect_list(F.struct("doc_id", "len", "f"))).alias("e"))
    found = found.select("phrase", *PLACE, F.size("e").alias("n"), F.col("e.doc_id").alias("ids"), F.col("e.len").alias("lens"), F.col("e.f").alias("fs"))
    hits = stored(found.withColumn("peaks", G.peaks(F.col("fs"), F.col("lens"))), "hits")
    return plain.unionByName(hits)


def document_frequencies(index: G.Index, phrases: DataFrame, blocks: DataFrame) -> DataFrame:
    """``phrase, df``: pages that hold each phrase. Single words have kept counters; the hits of the others are counted."""
    single, rows = G.held(phrases.where("size(tokens) = 1").select("phrase", "title_only", F.col("tokens")[0].alias("term")), "words")
    kept = G.counts_of(index, single, rows).join(single, "term")
    kept = kept.select("phrase", F.when(F.col("title_only"), F.col("n_title_docs")).otherwise(F.col("n_docs")).alias("df"))
    more = phrases.where("size(tokens) > 1").select("phrase")
    hits = blocks.join(more, "phrase", "left_semi")
    if index.names("tombs"):
        hits = index.living(hits.select("phrase", "seq", F.explode("ids").alias("doc_id"))).groupBy("phrase").agg(F.count("*").alias("df"))
    else:
        hits = hits.groupBy("phrase").agg(F.sum("n").cast("long").alias("df"))
    return kept.unionByName(hits).where("df > 0")


def _bound(index: G.Index) -> Column:
    """The best share that a page of the block can have; a share is the smaller, the better."""
    return F.col("weight") * F.array_min(F.transform("peaks", lambda x: R.bm25_part(F.lit(1.0), x["f"], x["len"], F.lit(index.avg_tokens))))


def _met(index: G.Index, need: DataFrame, blocks: DataFrame) -> DataFrame:
    """``sid, n_phrases, seq, slice, bound, least, rare``: slices that hold all phrases of a search, the best rank possible there, and
    the pages and, if there are several, the phrase of the smallest block. Begins with the search's rarest phrase; reads no arrays of pages."""
    facts = blocks.select("phrase", *PLACE, "n", "peaks")
    rarest = need.groupBy("sid", "n_phrases").agg(F.min(F.struct("df", "phrase"))["phrase"].alias("phrase"), F.count("*").alias("c"))
    rarest = rarest.where("c = n_phrases").drop("c")           # a phrase without hits has no row; then the search has none either
    at = rarest.join(facts.select("phrase", *PLACE), "phrase").select("sid", "n_phrases", *PLACE)
    every = at.join(need.select("sid", "phrase", "weight"), "sid").join(facts, ["phrase", *PLACE]).withColumn("bound", _bound(index))
    return (every.groupBy("sid", "n_phrases", *PLACE).agg(F.count("*").alias("c"), F.sum("bound").alias("bound"), F.min("n").alias("least"),
                                                            F.min(F.struct("n", "phrase"))["phrase"].alias("rare"))
            .where("c = n_phrases").drop("c").withColumn("rare", F.when(F.col("n_phrases") > 1, F.col("rare"))))


def _evaluated(index: G.Index, need: DataFrame, blocks: DataFrame, at: DataFrame) -> DataFrame:
    """``sid, doc_id, rank`` of all hits in the given slices (``MET``)."""
    rows = _with_few(at, blocks, "phrase").join(need.select("sid", "phrase", "weight"), "sid").join(blocks.drop("peaks"), ["phrase", *PLACE])
    entry = F.explode(_among_few(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("lens").alias("len"), F.col("fs").alias("f")))).alias("x")
    rows = rows.select("sid", "n_phrases", "seq", "weight", entry)
    share = R.bm25_part(F.col("weight"), F.col("x.f"), F.col("x.len"), F.lit(index.avg_tokens))
    rows = rows.select("sid", "n_phrases", "seq", F.col("x.doc_id").alias("doc_id"), share.alias("share"))
    found = rows.groupBy("sid", "n_phrases", "seq", "doc_id").agg(F.count("*").alias("c"), F.sum("share").alias("rank")).where("c = n_phrases")
    return index.living(found.select("sid", "seq", "doc_id", "rank")).drop("seq")


def _best(index: G.Index, need: DataFrame, blocks: DataFrame, met: DataFrame, depth: DataFrame) -> DataFrame:
    """All hits that can be among a search's first ``depth`` (``sid, depth``): a first look at the most promising slices, then those in reach."""
    met = stored(met.join(depth, "sid"), "met")
    turn = Window.partitionBy("sid").orderBy("bound", *PLACE).rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("early", F.coalesce(F.sum("least").over(turn), F.lit(0)) < F.col("depth").cast("long") * 2)
    met = stored(met, "met-in-turn")
    first = stored(_evaluated(index, need, blocks, met.where("early").select(*MET)), "first-look")
    place = F.row_number().over(Window.partitionBy("sid").orderBy("rank"))
    reached = (first.join(depth, "sid").withColumn("place", place).where("place = depth")
               .select("sid", (F.col("rank") * (1 - 1e-9)).alias("threshold")))             # ranks are sums of floats, in any order
    later = met.where("not early").join(reached, "sid", "left").where("threshold is null or bound <= threshold")
    later = stored(later.select(*MET), "later")
    return first.unionByName(_evaluated(index, need, blocks, later))


def weighed(index: G.Index, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each search needs (``sid, n_phrases, phrase, df, weight``), and the blocks of all phrases.

    ``wanted``: ``sid, phrases``, no ``sid`` twice, ``phrases`` as made by ``querylog.phrases``. A phrase of many searches is looked up once.
    """
    each = wanted.select(F.explode("phrases").alias("p")).select("p.title_only", "p.tokens").distinct().where("size(tokens) > 0")
    each, _ = G.held(each.withColumn("phrase", phrase_key(F.col("title_only"), F.col("tokens"))), "phrases")
    blocks = phrase_blocks(index, each)
    df = document_frequencies(index, each, blocks)
    keys = F.transform("phrases", lambda p: phrase_key(p.title_only, p.tokens))
    need = wanted.select("sid", keys.alias("keys"))
    need = need.select("sid", "keys", F.size(F.array_distinct("keys")).alias("n_phrases"), F.explode(F.array_distinct("keys")).alias("phrase"))
    times = F.size(F.filter("keys", lambda k: k == F.col("phrase")))
    weight = R.idf(F.lit(index.n_docs), F.col("df")) * F.col("times")
    need = need.select("sid", "n_phrases", "phrase", times.alias("times")).join(df, "phrase").withColumn("weight", weight)
    return G.held(need.select("sid", "n_phrases", "phrase", "df", "weight"), "need")[0], blocks


def _members(wanted: DataFrame, parts: Column, *more: str) -> DataFrame:
    """``wanted`` with ``set``, the name of what a search looks for (its ``parts``, in any order): equal for searches that find the same."""
    name = F.sha1(F.concat_ws("\x1f", F.sort_array(parts), *[F.col(c).cast("string") for c in more]))
    return G.held(wanted.withColumn("set", name), "members")[0]


def score_sets(index: G.Index, wanted: DataFrame, depth: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``score_searches`` before its hits are dealt out: ``set, doc_id, rank``, and ``set, sid``. Searches for the same phrases (and of the
    same depth) share a set, which is looked up once, however many searches there are."""
    keys = F.transform("phrases", lambda p: phrase_key(p.title_only, p.tokens))
    members = _members(wanted.select("sid", "phrases"), keys) if depth is None else _members(wanted.select("sid", "phrases").join(depth, "sid"), keys, "depth")
    need, blocks = weighed(index, members.groupBy("set").agg(F.first("phrases").alias("phrases")).withColumnRenamed("set", "sid"))
    met = _met(index, need, blocks)
    if depth is None:
        found = _evaluated(index, need, blocks, met.select(*MET))
    else:
        found = _best(index, need, blocks, met, members.select(F.col("set").alias("sid"), "depth").distinct())
    return found.withColumnRenamed("sid", "set"), members.select("set", "sid")


def score_searches(index: G.Index, wanted: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """``sid, doc_id, rank``: the pages that hold all phrases of each search, with BM25.

    With ``depth`` (``sid, depth``), pages that cannot be among a search's first ``depth`` may be missing, and the slices that hold
    only such are not read.
    """
    found, members = score_sets(index, wanted, depth)
    return salted_join(found, members, ["set"], "doc_id").select("sid", "doc_id", "rank")


def sets_with_all(index: G.Index, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pages_with_all`` before its pages are dealt out: ``set, doc_id``, and ``set, sid``."""
    members = _members(wanted.select("sid", F.array_distinct("terms").alias("terms")), F.col("terms"))
    sets = members.groupBy("set").agg(F.first("terms").alias("terms"))
    each = sets.select(F.col("set").alias("sid"), F.explode("terms").alias("phrase"), F.size("terms").alias("n_phrases"))
    each, _ = G.held(each, "searches")
    terms, rows = G.held(each.select(F.col("phrase").alias("term")).distinct(), "terms")
    df = G.counts_of(index, terms, rows).select(F.col("term").alias("phrase"), F.col("n_docs").alias("df")).where("df > 0")
    need = G.held(each.join(df, "phrase").withColumn("weight", F.lit(0.0)), "need")[0]
    blocks = G.blocks_of(index, terms, rows).withColumnRenamed("term", "phrase").select(*PHRASE_BLOCKS)
    found = _evaluated(index, need, blocks, _met(index, need, blocks).select(*MET))
    return found.select(F.col("sid").alias("set"), "doc_id"), members.select("set", "sid")


def pages_with_all(index: G.Index, wanted: DataFrame) -> DataFrame:
    """``sid, doc_id``: the pages that hold all terms of each search (``sid, terms``, at least one each)."""
    found, members = sets_with_all(index, wanted)
    return salted_join(found, members, ["set"], "doc_id").select("sid", "doc_id")
