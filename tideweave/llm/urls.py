"""URL filter by character language models; DataFrame operations only.

Ordered host and path rules decide first. URLs that they allow and block train two character models: variable-order
Markov models that mix orders 3 to 0, each order weighing in as far as its context was seen. The others are judged by
the mean log-likelihood difference per character, against a threshold at which both classes would be equally often wrong
if their scores were normal. A fifth of the ruled URLs, by hash, is held out of training and sets the threshold. Ratios and
scores are summed in whole units, so their order doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

# Host, path and verdict of each rule.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 3
#: Weight of the next lower order, in observations.
PRIOR = 2.0
ALPHABET = 256.0
#: The gram table is broadcast up to so many rows (about 20 bytes each), joined beyond.
SMALL_TABLE = 200_000
#: Units of a gram's ratio and of a score, per power of ten; one in so many ruled texts sets the threshold.
RATIO, SCORE, HELD = 10**9, 10**6, 5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty without a scheme."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def grams(text: Column) -> Column:
    """The ORDER + 1 characters up to each character and the end. Characters are cut once and shifted arrays zipped: a
    position counted from the text's start for each would take the square of its length."""
    chars = F.regexp_extract_all(F.concat(F.lit("\x02" * ORDER), text, F.lit("\x03")), F.lit("(?s)."), F.lit(0))
    out = F.slice(chars, 1, F.size(chars) - ORDER)
    for k in range(1, ORDER + 1):
        out = F.zip_with(out, F.slice(chars, k + 1, F.size(chars) - ORDER), lambda x, y: F.concat(x, y))
    return out


def held_out(text: Column) -> Column:
    """Whether a ruled text sets the threshold instead of training the models."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % HELD == 0


def ratio_table(seen: DataFrame) -> DataFrame:
    """log10 of the two models' ratio for each gram of seen(gram, a, r), from its counts, in units of 1 / RATIO."""
    asked = seen
    out = asked.select("gram")
    pa, pr = F.lit(1 / ALPHABET), F.lit(1 / ALPHABET)
    for k in range(ORDER + 1):
        tail = F.substring("gram", ORDER + 1 - k, k + 1)
        full = seen.groupBy(tail.alias(f"g{k}")).agg(F.sum("a").alias(f"a{k}"), F.sum("r").alias(f"r{k}"))
        ctx = full.groupBy(F.substring(f"g{k}", 1, k).alias(f"c{k}")).agg(F.sum(f"a{k}").alias(f"ca{k}"), F.sum(f"r{k}").alias(f"cr{k}"))
        out = out.withColumn(f"g{k}", tail).join(full, f"g{k}", "left").withColumn(f"c{k}", F.substring(f"g{k}", 1, k)).join(ctx, f"c{k}", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
        pa = (zero(f"a{k}") + PRIOR * pa) / (zero(f"ca{k}") + PRIOR)
        pr = (zero(f"r{k}") + PRIOR * pr) / (zero(f"cr{k}") + PRIOR)
    return out.select("gram", F.round((F.log10(pa) - F.log10(pr)) * RATIO).cast("bigint").alias("ratio"))


def _threshold(scored: DataFrame) -> float | None:
    """Where the two classes' scores cross, from the texts that were held out; from all ruled ones if a class has none."""
    n, x = F.col("n").cast("decimal(38,0)"), F.col("score").cast("decimal(38,0)")
    rows = scored.filter("ruled is not null").groupBy("ruled", "held").agg(F.sum(n * x).cast("decimal(38,0)").alias("s"), F.sum((n * x * x).cast("decimal(38,0)")).alias("q"), F.sum("n").alias("n")).collect()
    for chosen in ([r for r in rows if r.held], rows):
        at = {}
        for verdict in {r.ruled for r in chosen}:
            s, q, m = (sum(int(r[c]) for r in chosen if r.ruled == verdict) for c in ("s", "q", "n"))
            at[verdict] = (s / m, max(q / m - (s / m) ** 2, 0.0) ** 0.5 + 1)
        if len(at) == 2:
            (ma, sa), (mr, sr) = at["allow"], at["block"]
            return (ma * sr + mr * sa) / (sa + sr)
    return None


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages(page_id, url, ...) to (page_id, host, path, rule, verdict, score), one row per row of pages.

    The models learn and judge whole urls. score is the mean log10 ratio of a character, null where a rule decides. A null
    url is judged as an empty text; urls without a scheme have empty host and path. If the rules allow or block no row,
    there is nothing to learn and the rest is allowed. Of rules that fit, the longest wins; a url at the threshold is
    allowed. A url of any length takes time in proportion, and its characters are rows of their own. An empty table gives
    no rows. Repeated rows give repeated results; other columns are ignored, so their names can't clash.
    """
    url = F.col("url").cast("string")
    host, path = split_url(url)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(url, F.lit("")).alias("text"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"))
    # equal texts are counted once and weighed by their rows, so a url that fills a third of the table is one row here.
    # They are dealt to all tasks before they are cut to grams, which are counted before they are shuffled.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = cut(rows.groupBy("text", "ruled").agg(F.count("*").alias("n")).repartition(parts, "text").select("*", held_out(F.col("text")).alias("held"), F.monotonically_increasing_id().alias("id")))
    # a gram's row has its text's number alone: with the text itself a long one would be copied for each character
    spread = texts.select("id", "ruled", "held", "n", F.explode(grams(F.col("text"))).alias("gram"))
    of = lambda verdict: F.sum(F.when((F.col("ruled") == verdict) & ~F.col("held"), F.col("n")).otherwise(0))
    seen = cut(spread.groupBy("gram").agg(of("allow").alias("a"), of("block").alias("r")))
    table = cut(ratio_table(seen))
    table = F.broadcast(table) if table.count() <= SMALL_TABLE else table
    score = F.round(F.sum("ratio") / F.count("ratio") * (SCORE / RATIO)).cast("bigint")
    scored = cut(spread.join(table, "gram").groupBy("id", "ruled", "held", "n").agg(score.alias("score")))
    threshold = _threshold(scored)
    open_ = scored.filter("ruled is null").select("id", "score").join(texts.select("id", F.col("text").alias("t")), "id").drop("id")
    allowed = F.lit(True) if threshold is None else F.col("score") >= F.lit(threshold)
    told = F.coalesce("ruled", F.when(allowed, "allow").otherwise("block"))
    decided = rows.filter("ruled is not null").withColumn("score", F.lit(None).cast("double"))
    left = rows.filter("ruled is null").join(open_, F.col("text") == F.col("t"), "left").drop("t")
    return decided.unionByName(left).select("page_id", "host", "path", "rule", told.alias("verdict"), (F.col("score") / SCORE).alias("score"))


def duckdb_sql() -> str:
    """The same over a table pages, without score."""
    fits = lambda h, p: f"(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')"
    by = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in by) + " end"
    said = "case " + " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in by) + " end"
    joins, pa, pr = "", f"{1 / ALPHABET}", f"{1 / ALPHABET}"
    tables = ""
    for k in range(ORDER + 1):
        tables += f", f{k} as (select substr(gram, {ORDER + 1 - k}, {k + 1}) as g, sum(a) as a, sum(r) as r from seen group by 1), c{k} as (select substr(g, 1, {k}) as c, sum(a) as a, sum(r) as r from f{k} group by 1)"
        joins += f" left join f{k} on f{k}.g = substr(q.gram, {ORDER + 1 - k}, {k + 1}) left join c{k} on c{k}.c = substr(q.gram, {ORDER + 1 - k}, {k})"
        pa = f"((coalesce(f{k}.a, 0)::double + {PRIOR} * {pa}) / (coalesce(c{k}.a, 0)::double + {PRIOR}))"
        pr = f"((coalesce(f{k}.r, 0)::double + {PRIOR} * {pr}) / (coalesce(c{k}.r, 0)::double + {PRIOR}))"
    pad = "||".join(["chr(2)"] * ORDER)
    crossed = "case when count(*) = 2 then (max(mean) filter (ruled = 'allow') * max(dev) filter (ruled = 'block') + max(mean) filter (ruled = 'block') * max(dev) filter (ruled = 'allow')) / sum(dev) end"
    moments = "select ruled, sum(n * score)::double / sum(n) as mean, sqrt(greatest(sum(n::hugeint * score * score)::double / sum(n) - (sum(n * score)::double / sum(n)) ** 2, 0)) + 1 as dev from s where ruled is not null"
    return f"""
with u as (
  select page_id, coalesce(url, '') as t, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, t, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u
), b as (
  select *, {rule} as rule, {said} as ruled from h
), d as (
  select t, ruled, count(*) as n, ('0x' || substr(md5(t), 1, 8))::bigint % {HELD} = 0 as held from b group by all
), e as (
  select t, ruled, held, n, unnest(list_transform(range(1, length(t) + 2), lambda i: substr({pad} || t || chr(3), i, {ORDER + 1}))) as gram from d
), seen as (
  select gram, sum(case when ruled = 'allow' then n else 0 end) as a, sum(case when ruled = 'block' then n else 0 end) as r from e where ruled is not null and not held group by 1
){tables}, ratio as (
  select q.gram, round((log10({pa}) - log10({pr})) * {RATIO})::bigint as x from (select distinct gram from e) q {joins}
), s as (
  select t, ruled, held, any_value(n) as n, round(sum(x)::double / count(*) * {SCORE / RATIO})::bigint as score from e join ratio using (gram) group by t, ruled, held
), z as (
  select coalesce((select {crossed} from ({moments} and held group by 1)), (select {crossed} from ({moments} group by 1)), '-inf'::double) as threshold
)
select page_id, host, path, rule, coalesce(b.ruled, case when s.score >= (select threshold from z) then 'allow' else 'block' end) as verdict
from b left join s on b.t = s.t and b.ruled is null and s.ruled is null
"""
