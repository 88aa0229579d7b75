"""URL filter: explicit rules first, else empirical-Bayes reputation of the host.

Outcomes of labelled pages are summed per host, and shrunk through beta-binomial priors: a
suffix towards the overall rate, a registered domain towards its suffix, a host towards its
domain.  How strongly is estimated at each level from the spread of its units (moments).  A host
without labelled pages has its prior: the rate of its domain, else of its suffix, else overall.  A
page is blocked when the lower bound of its host's posterior bad rate passes a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host, path); a rule fits its host and all subdomains.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
#: Bad rate that the bound must pass, and normal quantile of the bound (one-sided 95 %).
MAX_BAD, QUANTILE = 0.5, 1.645
#: Smallest and largest prior strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
SALTS = 16
#: Common suffixes of several labels under which names are registered or sites hosted (not all that there are).
SUFFIXES = tuple((
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk sch.uk nhs.uk com.au net.au org.au edu.au gov.au id.au co.nz net.nz "
    "org.nz govt.nz ac.nz co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr ac.kr go.kr com.cn net.cn org.cn gov.cn edu.cn com.tw org.tw "
    "edu.tw com.hk org.hk com.sg edu.sg com.my co.id or.id ac.id go.id co.th ac.th com.vn com.ph co.in net.in org.in ac.in gov.in "
    "com.pk com.bd com.tr org.tr edu.tr gov.tr co.il org.il ac.il com.sa com.eg co.za org.za ac.za gov.za com.ng co.ke com.br "
    "net.br org.br gov.br edu.br com.ar com.mx org.mx gob.mx com.co com.pe com.ve com.ec com.uy com.ua com.pl co.at or.at com.pt "
    "com.gr github.io gitlab.io readthedocs.io blogspot.com blogspot.co.uk blogspot.com.br wordpress.com herokuapp.com "
    "netlify.app vercel.app web.app pages.dev firebaseapp.com appspot.com azurewebsites.net cloudfront.net s3.amazonaws.com "
    "neocities.org").split())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first '://'; empty without one or for null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(action)
    return rule, action


def _last_labels(host: Column, more: int) -> Column:
    """The host's suffix (the longest of ``SUFFIXES``, else the last label) and ``more`` labels before it."""
    out = F.substring_index(host, ".", -1 - more)
    for n in sorted({s.count(".") + 1 for s in SUFFIXES}):
        fits = F.substring_index(host, ".", -n).isin([s for s in SUFFIXES if s.count(".") + 1 == n])
        out = F.when(fits, F.substring_index(host, ".", -n - more)).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    return _last_labels(host, 0)


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and the label before it; a suffix itself stands for its domain."""
    return _last_labels(host, 1)


def strength(units: DataFrame, mean: str) -> float:
    """Prior strength 1/rho - 1, where rho is the moment estimate of the units' overdispersion
    about ``mean``; one row comes to the driver."""
    m, n = F.col(mean), F.col("_n")
    spread = m * (1 - m)
    row = units.agg(F.sum((F.col("_k") - n * m) * (F.col("_k") - n * m) - n * spread).alias("a"),
                    F.sum(n * (n - 1) * spread).alias("b")).first()
    if not row["b"] or row["a"] is None or row["a"] <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, row["b"] / row["a"] - 1))


def host_reputation(outcomes: DataFrame, host_col: str = "host", bad_col: str = "bad",
                    quantile: float = QUANTILE, others: DataFrame | None = None) -> DataFrame:
    """Per host: _host, bad_rate (posterior mean), bad_bound (its lower bound).

    ``outcomes`` has a row per labelled page; bad is 0/1, and rows where it is null are left out.
    ``others`` has a column _host, each host once: those without labelled pages are judged by their
    prior alone.
    """
    hosts = (outcomes.filter(F.col(bad_col).isNotNull())
             .groupBy(F.coalesce(F.col(host_col), F.lit("")).alias("_host"))
             .agg(F.count("*").cast("double").alias("_n"), F.sum(F.col(bad_col).cast("double")).alias("_k"))
             .withColumn("_domain", domain_of(F.col("_host")))
             .withColumn("_suffix", suffix_of(F.col("_host"))))
    total = hosts.agg(F.sum("_n").alias("n"), F.sum("_k").alias("k")).first()
    overall = ((total["k"] or 0.0) + 0.5) / ((total["n"] or 0.0) + 1.0)

    def level(frame, key, parent):
        return frame.groupBy(key, *parent).agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k"))

    def shrunk(units, mean, name):
        t = strength(units, mean)
        return units.withColumn(name, (F.col("_k") + t * F.col(mean)) / (F.col("_n") + t)), t

    suffixes, _ = shrunk(level(hosts, "_suffix", []).withColumn("_m0", F.lit(overall)), "_m0", "_m1")
    domains, _ = shrunk(level(hosts, "_domain", ["_suffix"]).join(suffixes.select("_suffix", "_m1"), "_suffix"),
                        "_m1", "_m2")
    labelled = hosts
    hosts = hosts.join(domains.select("_domain", "_m2"), "_domain")
    hosts, t = shrunk(hosts, "_m2", "bad_rate")
    hosts = hosts.select("_host", "_n", "bad_rate")
    if others is not None:
        # many hosts may share a domain, and most a suffix
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        unseen = (others.join(labelled.select("_host"), "_host", "left_anti")
                  .select("_host", domain_of(F.col("_host")).alias("_domain"),
                          F.pmod(F.xxhash64("_host"), F.lit(SALTS)).cast("int").alias("_salt"))
                  .withColumn("_suffix", suffix_of(F.col("_host")))
                  .join(domains.select("_domain", "_m2", salt), ["_domain", "_salt"], "left")
                  .join(suffixes.select("_suffix", "_m1", salt), ["_suffix", "_salt"], "left"))
        hosts = hosts.unionByName(unseen.select("_host", F.lit(0.0).alias("_n"),
                                                F.coalesce("_m2", "_m1", F.lit(overall)).alias("bad_rate")))
    sd = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("_n") + t + 1))
    return hosts.select("_host", "bad_rate", (F.col("bad_rate") - quantile * sd).alias("bad_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD,
                quantile: float = QUANTILE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    A null url, or one without '://', has an empty host and path.  The longest fitting rule
    decides; else the host's reputation does, which for a host without labelled pages is the prior
    of its domain or suffix.  Other columns of ``pages`` are not read, and repeated rows are judged
    one by one.
    """
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("_host"), path_of(url).alias("_path"))
    rule, action = rule_of(F.col("_host"), F.col("_path"), rules)
    judged = judged.select("*", rule.alias("_rule"), action.alias("_action"))
    others = judged.filter("_action is null").groupBy("_host").agg(F.lit(1)).select("_host")
    bad = (host_reputation(outcomes, quantile=quantile, others=others).filter(F.col("bad_bound") > max_bad)
           .select("_host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("_bad")))
    return (judged.withColumn("_salt", F.pmod(F.xxhash64("_id", "_path"), F.lit(SALTS)).cast("int"))
            .join(bad, ["_host", "_salt"], "left")
            .select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
                    F.col("_rule").alias("rule"),
                    F.coalesce("_action", F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow")))
                    .alias("verdict")))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of labelled pages: the last number of a url's path is the id of its document,
    and a page is bad where that document's quality label is 0."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:/|\.html)?$", 1)
    keyed = (pages.select(host_of(F.col("url")).alias("host"), number.alias("_number")).filter("_number != ''")
             .select("host", F.col("_number").cast("long").alias("_doc")))
    marks = (labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_doc"))
             .agg(F.min("quality").alias("_q")))
    return keyed.join(marks, "_doc").select("host", (F.col("_q") == 0).cast("int").alias("bad"))
