"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Fixed patterns give the base spans. Every value found, and every long mixed token that no base span covers, is hashed
and counted over the whole corpus by distinct repository and owner. A value under few owners is owner-specific and
looks live, however many documents of theirs hold it; one that many owners hold is a copied example. Where repositories
are larger than documents, one in many of them is a copied example too. Tokens that look live add spans of the kind ``owned``.

Positions come from the pieces between matches. Texts never move: only hashes and positions are counted, and only rows
with findings are joined with the verdicts, which are aggregated before each shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Kind and pattern of base spans.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
SPAN = "struct<start:int,rank:int,end:int,hash:string>"


@dataclass(frozen=True)
class Ownership:
    """A value under at most this many owners and repositories is owner-specific; without ``repositories``, owners alone
    decide."""

    owners: int = 2
    repositories: int | None = 20


#: For documents that are their own repositories: copies inside one owner are no wide copying.
BY_OWNER = Ownership(repositories=None)


def _spans(matches: Column, pieces: Column, rank: int, value) -> Column:
    """Structs (start, rank, end, hash of the value) of matches between ``pieces``, positions in code points."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"),
                        F.sha2(value(pair["match"]), 256).alias("hash"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    pairs = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)),
                       lambda m, p: F.struct(p.alias("piece"), m.alias("match")))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, begin, step, lambda acc: acc["out"])).otherwise(
        F.array().cast(f"array<{SPAN}>"))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_tokens``: spans of the base patterns in ``_text``, and of long tokens clear of them."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN}
    out = docs.withColumns({f"_m_{k}": F.regexp_extract_all("_text", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    out = out.withColumns({f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, F.split("_text", p, -1))
                           for k, p in patterns.items()})
    assigned = lambda m: F.regexp_extract(m, ASSIGN, 2)
    whole = lambda m: m
    out = out.withColumns({
        "_s_assign": _spans(F.col("_m_assign"), F.col("_p_assign"), 0, assigned),
        "_s_access": _spans(F.col("_m_access"), F.col("_p_access"), 1, whole),
        "_s_hex": _spans(F.col("_m_hex"), F.col("_p_hex"), 2, whole),
        "_s_token": _spans(F.col("_m_token"), F.col("_p_token"), 3, whole)})
    long_enough = F.filter(F.zip_with("_s_assign", "_m_assign", lambda s, m: F.struct(s.alias("s"), m.alias("m"))),
                           lambda x: F.length(assigned(x["m"])) >= 6)
    base = F.array_sort(F.concat(F.transform(long_enough, lambda x: x["s"]), "_s_access", "_s_hex"))
    mixed = F.filter(F.zip_with("_s_token", "_m_token", lambda s, m: F.struct(s.alias("s"), m.alias("m"))),
                     lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
    out = out.withColumn("_base", base).withColumn("_mixed", F.transform(mixed, lambda x: x["s"]))
    clear = F.filter("_mixed", lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return out.withColumn("_tokens", clear).select(*docs.columns, "_base", "_tokens")


def ownership(found: DataFrame, limits: Ownership = Ownership()) -> DataFrame:
    """(hash, n_owners, n_repositories, live) of every value in ``found`` (hash, _repo, _owner)."""
    live = F.col("n_owners") <= limits.owners
    if limits.repositories is not None:
        live &= F.col("n_repositories") <= limits.repositories
    per_owner = found.select("hash", "_owner", "_repo").distinct().groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("n"))
    return (per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))
            .withColumn("live", live))


def _judged(docs: DataFrame, keep: list[str], repository: str, owner: str, text: str,
            limits: Ownership | None) -> DataFrame:
    """``_all``, a structure of the ``keep`` columns, with base and found; no column of ``docs`` can clash."""
    limits = limits or (BY_OWNER if repository == "doc_id" else Ownership())
    own = docs.select(F.struct(*keep).alias("_all"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
                      F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("_repo"),
                      F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"),
                      F.monotonically_increasing_id().alias("_row"))
    stored = durable(find(own).select("_all", "_row", "_repo", "_owner", "_base", "_tokens"))
    some = (F.size("_base") > 0) | (F.size("_tokens") > 0)
    items = stored.where(some).select("_row", "_repo", "_owner", F.explode(F.concat("_base", "_tokens")).alias("s"))
    items = items.select("_row", "_repo", "_owner", "s.start", "s.rank", "s.end", "s.hash")
    judged = items.join(ownership(items, limits).select("hash", "live"), "hash")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    rows = (judged.where("rank < 3 OR live").groupBy("_row").agg(F.array_sort(F.collect_list(
        F.struct("start", "rank", "end", kind.alias("kind"), "live"))).alias("found")))
    shape = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                               s["live"].alias("live"))
    rows = rows.select("_row", F.transform(F.filter("found", lambda s: s["rank"] < 3), shape).alias("base"),
                       F.transform("found", shape).alias("found"))
    empty = F.array().cast("array<struct<start:int,kind:string,end:int,live:boolean>>")
    with_some = stored.where(some).join(rows, "_row", "left").select(
        "_all", F.coalesce("base", empty).alias("base"), F.coalesce("found", empty).alias("found"))
    return with_some.unionByName(stored.where(~some).select("_all", empty.alias("base"), empty.alias("found")))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", text: str = "text",
         keep: list[str] | None = None, limits: Ownership | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) with ``base`` and ``found``, arrays of (start, kind, end, live) by
    start, then kind: base spans alone, and base spans with the owned ones. Columns of these two names are replaced.
    Without ``limits`` owners alone decide if ``doc_id`` is the repository, else those of ``Ownership``.

    Null and empty texts hold nothing. A missing repository or owner counts as one of its own. Repeated rows are
    judged and returned each; no rows give no rows. Positions are code points, ends exclusive."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "found")]
    return _judged(docs, keep, repository, owner, text, limits).select("_all.*", "base", "found")


def listed(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))))


def secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): counts by base kind, digest of the base spans, all spans, and how many
    findings look live or are copied examples."""
    found = scan(docs.select("doc_id", "text", "source"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_copied"))


def redact(docs: DataFrame, text: str = "text", live: str = "[SECRET]", copied: str = "[EXAMPLE-SECRET]",
           repository: str = "doc_id", owner: str = "source", limits: Ownership | None = None) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by a mark that tells live ones from copied examples.

    Overlapping findings become one mark, a live one if any of them is live."""
    found = _judged(docs, docs.columns, repository, owner, text, limits)
    whole = F.col(f"_all.{text}")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).alias("stop"), F.lit(False).alias("live"))

    def close(acc: Column) -> Column:
        mark = F.when(acc["live"], F.lit(live)).otherwise(F.lit(copied))
        return F.when(acc["stop"] > 0, F.concat(acc["out"], mark)).otherwise(acc["out"])

    def step(acc: Column, s: Column) -> Column:
        joins = s["start"] < acc["stop"]
        gap = F.substring(whole, acc["stop"] + 1, s["start"] - acc["stop"])
        return F.struct(s["start"].alias("at"), F.when(joins, acc["out"]).otherwise(F.concat(close(acc), gap)).alias("out"),
                        F.greatest(acc["stop"], s["end"]).alias("stop"),
                        F.when(joins, acc["live"] | s["live"]).otherwise(s["live"]).alias("live"))

    def end(acc: Column) -> Column:
        return F.concat(close(acc), F.substring(whole, acc["stop"] + 1, F.length(whole)))

    cut = F.aggregate("found", begin, step, end)
    new = F.when(F.size("found") > 0, cut).otherwise(whole).alias(text)
    return found.select(*[new if c == text else F.col(f"_all.{c}") for c in docs.columns])
