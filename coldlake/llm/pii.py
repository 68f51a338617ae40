"""Personal data by pattern, and terms that disclose it by corpus co-occurrence; built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import staged

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the base kinds, with possessive loops and a run-start condition: they match
# the same spans as the plain forms, in linear time and without recursion on long runs.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BLOCK = 256
#: Stands for each character of an e-mail address while a text's words are taken.
_MASK = "\uE000"
#: Runs of three letters or more that touch no e-mail address.
_WORD = rf"(?<![\p{{L}}{_MASK}])\p{{L}}{{3,}}+(?!{_MASK})"
#: Most text keys, of 8 bytes each, that are broadcast to find the texts.
BROADCAST_KEYS = 500_000


@dataclass(frozen=True)
class Disclosure:
    """When a term in the texts of an entity reveals it.

    ``threshold``: the share of the entity's information content that the term gives away,
    PMI(term, entity) / IC(entity). ``min_texts``: different texts that must support the pair.
    """

    threshold: float = 0.8
    min_texts: int = 3


def _is_ip(x: Column) -> Column:
    def small(p):
        bare = F.regexp_replace(p, "^0+(?=.)", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))
    return F.forall(F.split(x, r"\."), small)


def _is_card(x: Column) -> Column:
    digits = F.translate(x, " -", "")
    n = F.length(digits)

    def weight(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + weight(i)) % 10 == 0
    return F.when(n.between(14, 19), luhn).otherwise(False)


def _is_phone(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^0-9]", "")).between(10, 15)


_VALID = {"email": lambda x: F.lit(True), "ip": _is_ip, "card": _is_card, "phone": _is_phone}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_VALUE = {"email": F.lower, "ip": lambda x: x, "card": lambda x: F.translate(x, " -", ""), "phone": lambda x: F.regexp_replace(x, "[^0-9]", "")}
#: What a value shares with others, so that a rare one still has texts to estimate from.
_PARTS = {"email": {"name": lambda v: F.substring_index(v, "@", 1), "domain": lambda v: F.substring_index(v, "@", -1)}, "ip": {"net": lambda v: F.substring_index(v, ".", 3)},
          "card": {"issuer": lambda v: F.left(v, F.lit(6))}, "phone": {"area": lambda v: F.left(v, F.lit(6))}}


def _matches(df: DataFrame, text: str, pattern: str, maybe: Column):
    """Adds m, g, steps and blocks, the matches in ``text`` and the gaps between them; a function for the start of match i.

    Offsets are running sums of the lengths, taken in blocks so that a text with very many
    matches stays cheap.
    """
    df = df.withColumn("m", F.when(maybe, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("g", F.when(F.size("m") > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("steps", F.transform("m", lambda x, i: F.char_length(x) + F.char_length(F.get("g", i))))

    def total(start, count):
        return F.aggregate(F.slice("steps", start, count), F.lit(0), lambda s, x: s + x)
    df = df.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.floor(F.size("m") / _BLOCK).cast("int")), lambda b: total(F.lit(1), b * _BLOCK)))

    def start(i):
        at = (i / _BLOCK).cast("int")
        return F.get("blocks", at) + total(at * _BLOCK + 1, i % _BLOCK) + F.char_length(F.get("g", i))
    return df, start


def _with_spans(df: DataFrame, kind: str) -> DataFrame:
    """Adds ``kind``: array of start, end, rank, kind and value of its valid matches."""
    needs = _NEEDS[kind]
    df, start = _matches(df, "body", PATTERNS[kind], F.contains("body", F.lit(needs)) if needs else F.col("body").rlike("[0-9]{2}|[0-9][ -][0-9]"))

    def span(x, i):
        return F.struct(start(i).alias("start"), (start(i) + F.char_length(x)).alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"),
                        _VALUE[kind](x).alias("value"), x.alias("raw"))
    return df.withColumn(kind, F.filter(F.transform("m", span), lambda s: _VALID[kind](s["raw"]))).drop("m", "g", "steps", "blocks")


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged rows (doc_id, t, base), one per input row; ``base`` is sorted by start, then kind."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    for kind in KINDS:
        df = _with_spans(df, kind)
    df = df.select("doc_id", F.xxhash64("body").alias("t"), F.array_sort(F.concat(*[F.col(k) for k in KINDS])).alias("all"))
    return staged(df.select("doc_id", "t", F.transform("all", lambda s: s.dropFields("raw")).alias("base")), "base")


def _entities(s: Column) -> Column:
    """The value of a base span and the parts that it shares with others, as distinct strings."""
    parts = [F.when(s["kind"] == kind, F.concat(F.lit(f"{kind} {name}:"), f(s["value"]))) for kind, of in _PARTS.items() for name, f in of.items()]
    return F.array_compact(F.array(F.concat_ws(":", s["kind"], s["value"]), *parts))


def _masked(docs: DataFrame, keys: DataFrame, text_col: str) -> DataFrame:
    """Rows (t, text) of the texts in ``keys``, of equal length, with _MASK over e-mail addresses."""
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys  # else the texts are shuffled to the keys
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(keys, "t")
    hidden = F.transform(F.regexp_extract_all("text", F.lit(PATTERNS["email"]), F.lit(0)), lambda x: F.repeat(F.lit(_MASK), F.char_length(x)))
    joined = F.array_join(F.zip_with(F.split("text", PATTERNS["email"], -1), hidden, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    return texts.withColumn("text", F.when(F.contains("text", F.lit("@")), joined).otherwise(F.col("text")))


def disclosing_terms(docs: DataFrame, base: DataFrame, rule: Disclosure = Disclosure(), text_col: str = "text") -> DataFrame:
    """Rows (t, start, end, term): all occurrences of terms that give away an entity of their text.

    Entities are the distinct values of the base spans and the parts they share with other
    values (name and domain of an e-mail address, network, issuer, area), so that a value of
    one text is judged by the texts of its parts. n(.) counts different texts, so copies add no
    evidence: PMI(term, entity) = log2(n(both) N / (n(term) n(entity))), and the term discloses
    the entity when PMI / log2(N / n(entity)) reaches the threshold. n(both) counts whole
    texts. Words that touch an e-mail address are no terms; other base spans have no letters.
    """
    owner = staged(base.select("t", F.explode(F.flatten(F.transform("base", _entities))).alias("entity")).distinct(), "entities")
    n_texts = base.agg(F.count_distinct("t").alias("n")).first()["n"]
    total = F.lit(float(n_texts))
    entity = owner.groupBy("entity").agg(F.count("*").alias("n_entity")).where((F.col("n_entity") >= rule.min_texts) & (F.col("n_entity") < n_texts))
    owned = staged(owner.join(entity, "entity"), "owned")
    texts = _masked(docs, staged(owned.select("t").distinct(), "owners"), text_col)
    words = staged(texts.select("t", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), lambda x: F.lower(x)))).alias("term")).distinct(), "words")

    def disclosure(n_term):
        return F.log2(F.col("n_both") * total / (F.col(n_term) * F.col("n_entity"))) / F.log2(total / F.col("n_entity"))

    def possible(n_entity):  # n(both) is n(entity) at most
        return F.col("n_seen") <= total * F.pow(F.col(n_entity) / total, F.lit(rule.threshold)) * (1 + 1e-9)
    # These texts are some of all, so their count bounds n(term) from below: pairs that fail
    # with it fail with n(term), and frequent words are never counted over the corpus.
    most = owned.agg(F.max("n_entity").alias("most"))
    seen = words.groupBy("term").agg(F.count("*").alias("n_seen")).where(F.col("n_seen") >= rule.min_texts).crossJoin(F.broadcast(most)).where(possible("most")).drop("most")
    likely = staged(words.join(seen, "term"), "likely")
    both = (owned.join(likely, "t").where(possible("n_entity")).groupBy("entity", "term", "n_entity", "n_seen").agg(F.count("*").alias("n_both"))
            .where((F.col("n_both") >= rule.min_texts) & (disclosure("n_seen") >= rule.threshold)))
    pairs = staged(both, "pairs")
    terms = staged(pairs.select("term").distinct(), "terms")
    body = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.select(F.xxhash64(body).alias("t"), F.explode(F.array_distinct(F.split(F.lower(body), r"[^\p{L}]+"))).alias("term"))
    counts = every.join(terms, "term", "left_semi").groupBy("term").agg(F.count_distinct("t").alias("n_term"))
    guilty = staged(pairs.join(counts, "term").where(disclosure("n_term") >= rule.threshold).select("entity", "term"), "guilty")
    concerned = staged(owned.join(guilty, "entity").join(words, ["t", "term"]).groupBy("t").agg(F.collect_set("term").alias("terms")), "concerned")
    placed, start = _matches(_masked(docs, concerned, text_col).dropDuplicates(["t"]), "text", _WORD, F.lit(True))
    found = F.filter(F.transform("m", lambda x, i: F.struct(i.alias("i"), F.lower(x).alias("term"), F.char_length(x).alias("size"))), lambda w: F.array_contains("terms", w["term"]))
    at = F.transform(found, lambda w: F.struct(start(w["i"]).alias("start"), (start(w["i"]) + w["size"]).alias("end"), w["term"].alias("term")))
    return placed.select("t", F.inline(at))


def find(docs: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, t, base, terms), one per input row; ``terms`` are the method's added spans.

    Null text counts as empty and has no spans; null ids work; rows that repeat are answered
    each; other columns are ignored; an empty table gives no rows.
    """
    base = base_spans(docs, id_col, text_col)
    added = (disclosing_terms(docs, base, rule, text_col).groupBy(F.col("t").alias("key"))
             .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms")))
    both = base.join(added, base["t"] == added["key"], "left")
    return both.select("doc_id", "t", F.transform("base", lambda s: F.struct(s["start"], s["end"], s["rank"], s["kind"])).alias("base"),
                       F.coalesce("terms", F.array().cast("array<struct<start:int,end:int>>")).alias("terms"))


def all_spans() -> Column:
    """Base and added spans of ``find`` by start, then kind as listed, terms last."""
    terms = F.transform("terms", lambda s: F.struct(s["start"], s["end"], F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind")))
    return F.array_sort(F.concat("base", terms), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def base_by_start() -> Column:
    return F.array_sort("base", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure(), remove_terms: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with base spans generalised to their kind, [EMAIL], and terms to [TERM] or cut.

    Where spans overlap, the earlier one is replaced and the later one's rest is cut. Null
    texts stay null and other columns pass through.
    """
    found = find(docs, rule, id_col, text_col).select(F.col("doc_id").alias("id"), F.col("t").alias("key"), all_spans().alias("spans")).distinct()
    src = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    both = src.join(found, src["doc_id"].eqNullSafe(found["id"]) & (src["t"] == found["key"]))
    body = F.col(f"row.`{text_col}`")

    def step(acc, s):
        mark = F.when((s["kind"] == "term") & F.lit(remove_terms), "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        gap = F.substring(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(gap, mark)).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))
    cut = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.char_length(body))))
    return both.select(*[(cut if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
