"""Candidate tiers: which clauses of a document are worth comparing; and which reported conflicts count.

Every join is keyed by the document, so that pairs arise within one document only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.operators.clauses import computed
from clausegrid.operators.pairs import capped_pairs

# Words of topics, of clusters, contrary terms and words of override, looked for in lower-cased texts.
TOPICS = {
    "payment": ("payment", "pay", "invoice", "fee", "compensation"),
    "termination": ("terminate", "termination", "cancel", "expiry"),
    "liability": ("liability", "liable", "indemnify", "indemnification"),
    "confidentiality": ("confidential", "confidentiality", "nda", "non-disclosure"),
    "intellectual_property": ("ip", "intellectual property", "patent", "copyright", "trademark"),
    "warranty": ("warranty", "warrant", "guarantee", "representation"),
    "dispute": ("dispute", "arbitration", "mediation", "jurisdiction", "governing law"),
}
CLUSTERS = {
    "payment": ("payment", "fee", "invoice", "cost", "price"),
    "termination": ("terminate", "cancellation", "end", "expiry"),
    "liability": ("liable", "liability", "indemnify", "damage"),
    "subcontractor": ("subcontractor", "subcontract", "third party"),
    "warranty": ("warrant", "guarantee", "assurance"),
    "confidential": ("confidential", "proprietary", "secret"),
    "intellectual_property": ("intellectual property", "ip", "patent"),
    "force_majeure": ("force majeure", "act of god"),
    "dispute": ("dispute", "arbitration", "mediation"),
    "governing_law": ("governing law", "jurisdiction"),
}
CONTRARY = (("shall", "shall not"), ("must", "must not"), ("mandatory", "optional"), ("required", "not required"), ("permitted", "prohibited"), ("allowed", "forbidden"))
OVERRIDES = ("notwithstanding", "subject to", "except as", "unless otherwise", "in lieu of", "supersede")


def mentions(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether a text holds one of the terms, also inside a word; small and capital letters are one."""
    return F.exists(F.array(F.lower(text)), lambda low: _holds(low, terms))


def _holds(low: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in terms])


def topics_of(text: Column, topics: dict[str, tuple[str, ...]]) -> Column:
    """The topics a text mentions, in their order; a null text mentions none. The text becomes small letters once, for all terms."""
    named = lambda low: F.array(*[F.when(_holds(low, terms), F.lit(name)) for name, terms in topics.items()])
    return F.array_compact(F.flatten(F.transform(F.array(F.lower(text)), named)))


def topic_pairs(items: DataFrame, most: int = 30, topics: dict[str, tuple[str, ...]] = TOPICS, id_col: str = "doc_id", pos: str = "pos", text: str = "content") -> DataFrame:
    """(id, i, j) for i < j among the first `most` clauses of a topic, each pair once. The limit is the tier's feature."""
    rows = items.select(id_col, pos, F.explode(topics_of(F.col(text), topics)).alias("topic"))
    return capped_pairs(rows, [id_col, "topic"], most, pos).select(id_col, "i", "j").distinct()


def cluster_pairs(items: DataFrame, clusters: dict[str, tuple[str, ...]] = CLUSTERS, id_col: str = "doc_id", pos: str = "pos", text: str = "content") -> DataFrame:
    """(id, i, j) for i < j of clauses that share a cluster. A pair comes from its first common cluster alone, so none arises twice."""
    rows = computed(items.select(F.col(id_col).alias("id"), F.col(pos).alias("pos"), F.col(text).alias("_text")), ["id", "pos"], all=topics_of(F.col("_text"), clusters))
    each = rows.withColumn("cluster", F.explode("all"))
    a, b = each.alias("a"), each.alias("b")
    first = F.element_at(F.array_intersect("a.all", "b.all"), 1)
    pairs = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.pos") < F.col("b.pos")) & (first == F.col("a.cluster")))
    return pairs.select(F.col("a.id").alias(id_col), F.col("a.pos").alias("i"), F.col("b.pos").alias("j"))


def contrary_pairs(items: DataFrame, id_col: str = "doc_id", pos: str = "pos", text: str = "content") -> DataFrame:
    """(id, i, j) for i < j where one clause holds a term and the other its contrary; a term inside a longer one counts.

    Clauses are read once: the places of both sides come together under the document and the pair of terms.
    """
    terms = {str(2 * k + side): (term,) for k, pair in enumerate(CONTRARY) for side, term in enumerate(pair)}
    found = items.select(F.col(id_col).alias("id"), F.col(pos).alias("pos"), F.explode(topics_of(F.col(text), terms).cast("array<int>")).alias("at"))
    side = lambda s: F.collect_list(F.when(F.col("at") % 2 == s, F.col("pos")))
    met = found.groupBy("id", F.floor(F.col("at") / 2).alias("k")).agg(side(0).alias("one"), side(1).alias("other"))
    pairs = met.select("id", F.explode("one").alias("a"), "other").select("id", "a", F.explode("other").alias("b")).filter("a <> b")
    return pairs.select(F.col("id").alias(id_col), F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()


def override_against_all(items: DataFrame, id_col: str = "doc_id", pos: str = "pos", text: str = "content") -> DataFrame:
    """(id, i, j): each clause i with words of override beside every other clause j of its document."""
    told = items.select(F.col(id_col).alias("id"), F.col(pos).alias("pos"), mentions(F.col(text), OVERRIDES).alias("over"))
    met = told.groupBy("id").agg(F.collect_list(F.when(F.col("over"), F.col("pos"))).alias("one"), F.collect_list("pos").alias("all"))
    pairs = met.select("id", F.explode("one").alias("i"), "all").select("id", "i", F.explode("all").alias("j"))
    return pairs.filter("i <> j").withColumnRenamed("id", id_col)


def with_texts(conflicts: DataFrame, items: DataFrame, id_col: str = "doc_id", pos: str = "pos", text: str = "content") -> DataFrame:
    """Conflicts (id, i, j, ...) with the texts of their clauses as text_i and text_j; one whose clause is not there goes."""
    out = conflicts
    for side in ("i", "j"):
        out = out.join(items.select(id_col, F.col(pos).alias(side), F.col(text).alias(f"text_{side}")), [id_col, side])
    return out


def believable(conflicts: DataFrame, confidence: float = 0.8, least_text: int = 20, least_description: int = 50) -> DataFrame:
    """Conflicts (with texts) of enough confidence, between clauses of substance, with a description that says something."""
    long_enough = (F.length("text_i") >= least_text) & (F.length("text_j") >= least_text) & (F.length("description") >= least_description)
    return conflicts.filter((F.col("confidence") >= confidence) & long_enough)


def verified(conflicts: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Conflicts (with texts) that the second pass keeps: both quotes stand in their clauses."""
    return conflicts.filter((F.col("confidence") >= confidence) & F.contains("text_i", F.col("quote_i")) & F.contains("text_j", F.col("quote_j")))


def evidence(conflicts: DataFrame, keys: list[str], most: int = 500) -> DataFrame:
    """A row per conflict and clause whose quote is found: start, end and the snippet, of at most `most` characters."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"text_{s}").alias("text"), F.col(f"quote_{s}").alias("quote")) for s in ("i", "j")])
    rows = conflicts.select(*keys, F.inline(sides)).withColumn("start", F.expr("locate(quote, text)") - 1).filter("quote <> '' AND start >= 0")
    snippet = F.substring("quote", 1, most)
    return rows.select(*keys, "side", "start", (F.col("start") + F.length(snippet)).alias("end"), snippet.alias("snippet"))


def unresolved(conflicts: DataFrame, versions: DataFrame, contract_id: Column | str) -> DataFrame:
    """Conflicts (version_id, status, ...) of a contract that are not resolved."""
    of = versions.filter(F.col("contract_id") == contract_id).select(F.col("id").alias("version_id"))
    return conflicts.join(of, "version_id", "left_semi").filter(F.col("status") != "RESOLVED")
