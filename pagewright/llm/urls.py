"""URL filters: allow and block rules, and logistic regression for all other URLs.

The classifier sees hashed character n-grams of host and path. It is trained from
a small labelled table by full-batch gradient descent. As every gradient is a
combination of training rows, the weights are kept as one coefficient per training
row (``w = sum(alpha_i * x_i)``) and the whole descent is one ``aggregate``
expression over the Gram matrix; only the finished weights, of which there are
at most ``buckets``, leave the cluster. Scoring is a fold over a literal array.
No Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labelled URLs, 1 = worth keeping, 0 = not.
LABELLED_URLS: tuple[tuple[str, int], ...] = (
    ("https://www.example.org/en/articles/history-of-printing", 1),
    ("https://docs.example.org/guide/getting-started.html", 1),
    ("https://blog.example.com/en/2021/why-rivers-bend", 1),
    ("https://news.example.net/en/science/48213", 1),
    ("https://library.example.org/fr/essais/montaigne", 1),
    ("https://www.example.net/de/artikel/20311.html", 1),
    ("https://m.example.com/es/noticias/33810", 1),
    ("https://wiki.example.org/en/Photosynthesis", 1),
    ("https://journal.example.org/volume/12/paper/7", 1),
    ("https://www.example.com/recipes/bread-and-butter", 1),
    ("https://university.example.org/courses/algebra/notes.html", 1),
    ("https://blog.example.net/fr/17211", 1),
    ("https://www.example.com/de/reisen/ostsee.html", 1),
    ("https://museum.example.org/en/collection/4410", 1),
    ("https://forum.example.org/en/topic/9921/answer", 1),
    ("https://stories.example.net/en/5120/", 1),
    ("https://www.example.org/es/historia/1230.html", 1),
    ("https://weather.example.com/en/explained/clouds", 1),
    ("https://books.example.net/en/chapter/3", 1),
    ("https://m.example.org/en/24110", 1),
    ("https://www.example.net/en/38450#top", 1),
    ("http://essays.example.com/en/on-walking", 1),
    ("https://health.example.org/en/articles/sleep", 1),
    ("https://www.example.com/fr/40211", 1),
    ("https://casino-bonus.example.com/play/slots/win", 0),
    ("https://cheap-pills.example.net/buy/now", 0),
    ("https://free-download.example.com/crack/keygen.exe", 0),
    ("https://xxx-videos.example.net/cams/live", 0),
    ("https://ads.example.com/track/click?id=1", 0),
    ("https://www.example.com/cart/checkout", 0),
    ("https://www.example.net/login?next=/account", 0),
    ("https://bet365-odds.example.org/poker/bonus", 0),
    ("https://www.example.com/wp-admin/admin-ajax.php", 0),
    ("https://seo-links.example.net/backlinks/buy", 0),
    ("https://replica-watches.example.com/sale/cheap", 0),
    ("https://adult-dating.example.net/xxx/profile", 0),
    ("https://track.example.org/pixel.gif", 0),
    ("https://warez.example.net/torrent/download/full", 0),
    ("https://payday-loans.example.com/apply/cash", 0),
    ("https://www.example.org/tag/sale/page/99", 0),
    ("https://cdn.example.com/assets/app.min.js", 0),
    ("https://slots.example.net/casino/free-spins", 0),
    ("https://viagra-online.example.org/cheap/pills", 0),
    ("https://clickbank.example.com/aff/redirect/offer", 0),
    ("https://www.example.net/search/results/buy+cheap", 0),
    ("https://crypto-doubler.example.com/win/bonus", 0),
    ("https://proxy-list.example.net/download/free.zip", 0),
    ("https://escort.example.org/cams/adult", 0),
)


@dataclass(frozen=True)
class Rule:
    """A rule for a host, its subdomains and a path prefix."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


@dataclass(frozen=True)
class UrlModel:
    """Weights of the trained classifier; ``weights`` has one entry per bucket."""

    weights: tuple[float, ...]
    bias: float
    sizes: tuple[int, ...]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(text, action); null if none does.

    The rules are a literal of the plan (at most 10,000). They are tried longest first; of
    equally long ones the longer host goes first, then ``block``.
    """
    if len(rules) > 10_000:
        raise ValueError("at most 10,000 rules fit in a plan")
    ordered = sorted(set(rules), key=lambda r: (-len(r.text), -len(r.host), r.action != "block", r.text))
    if not ordered:
        return F.lit(None).cast("struct<text:string,action:string>")
    listed = F.array(
        *(
            F.struct(
                F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.text).alias("text"), F.lit(r.action).alias("action")
            )
            for r in ordered
        )
    )
    fits = F.filter(
        listed,
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]),
    )
    first = F.try_element_at(fits, F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["text"].alias("text"), first["action"].alias("action")))


def _let(value: Column, body) -> Column:
    """Bind a value once: what stands in a lambda is evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngram_buckets(host: Column, path: Column, buckets: int, sizes: Sequence[int]) -> Column:
    """Distinct hashed n-grams. Both parts are framed, and a prefix keeps hosts and paths apart."""

    def grams(part: Column, mark: str, n: int) -> Column:
        starts = F.when(F.size(part) >= n, F.sequence(F.lit(0), F.size(part) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts, lambda i: F.pmod(F.xxhash64(F.concat(F.lit(mark), *(F.get(part, i + k) for k in range(n)))), F.lit(buckets)).cast("int")
        )

    def framed(part: Column) -> Column:
        return F.concat(F.array(F.lit("^")), F.filter(F.split(part, ""), lambda c: c != ""), F.array(F.lit("$")))

    found = [_let(framed(part), lambda chars: F.concat(*(grams(chars, mark, n) for n in sizes))) for part, mark in ((host, "h:"), (path, "p:"))]
    return F.array_distinct(F.concat(*found))


def train_url_model(
    spark: SparkSession,
    labelled: Sequence[tuple[str, int]] = LABELLED_URLS,
    buckets: int = 4096,
    sizes: Sequence[int] = (3, 4),
    steps: int = 200,
    rate: float = 4.0,
    ridge: float = 1e-3,
) -> UrlModel:
    """Fit the classifier on a labelled table of at most 2,000 URLs.

    Rows are scaled to unit length; the bias is a feature of weight one in every row. An
    empty table gives the zero model, which scores every URL 0.5.
    """
    if len(labelled) > 2_000:
        raise ValueError("the labelled table is limited to 2,000 URLs")
    if not labelled:
        return UrlModel((0.0,) * buckets, 0.0, tuple(sizes))
    rows = F.explode(
        F.array(*(F.struct(F.lit(i).alias("i"), F.lit(u).alias("url"), F.lit(float(y)).alias("y")) for i, (u, y) in enumerate(labelled)))
    )
    table = spark.range(1).select(rows.alias("r")).select("r.i", "r.y", ngram_buckets(host_of(F.col("r.url")), path_of(F.col("r.url")), buckets, sizes).alias("b"))
    data = table.agg(F.array_sort(F.collect_list(F.struct("i", "y", "b"))).alias("rows"))
    cell = lambda a, b: (
        F.size(F.array_intersect(a["b"], b["b"])) / F.sqrt(F.greatest(F.size(a["b"]), F.lit(1)).cast("double") * F.greatest(F.size(b["b"]), F.lit(1))) + 1.0
    )
    gram = data.select("rows", F.transform("rows", lambda a: F.transform("rows", lambda b: cell(a, b))).alias("gram"))
    gram = gram.agg(F.first("rows").alias("rows"), F.first("gram").alias("gram"))  # else the matrix is built anew in each step
    n = float(len(labelled))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)

    def step(alpha: Column, _: Column) -> Column:
        return F.transform(
            F.arrays_zip(alpha.alias("a"), F.col("gram").alias("g"), F.col("rows").alias("r")),
            lambda z: z["a"] * (1.0 - rate * ridge) - (1.0 / (1.0 + F.exp(-dot(z["g"], alpha))) - z["r"]["y"]) * (rate / n),
        )

    zero = F.transform("rows", lambda r: F.lit(0.0))
    fitted = gram.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step).alias("alpha"))
    spread = fitted.select(F.explode(F.arrays_zip(F.col("rows").alias("r"), F.col("alpha").alias("a"))).alias("z")).select(
        "z.a", F.explode(F.concat(F.array(F.lit(-1)), F.col("z.r.b"))).alias("bucket"), F.sqrt(F.greatest(F.size("z.r.b"), F.lit(1))).alias("norm")
    )
    found = spread.groupBy("bucket").agg(F.sum(F.when(F.col("bucket") < 0, F.col("a")).otherwise(F.col("a") / F.col("norm"))).alias("w"))
    weights = {r["bucket"]: round(r["w"], 12) for r in found.collect()}  # at most buckets + 1 rows
    return UrlModel(tuple(weights.get(k, 0.0) for k in range(buckets)), weights.get(-1, 0.0), tuple(sizes))


def url_score(host: Column, path: Column, model: UrlModel) -> Column:
    """Probability that a URL is worth keeping."""
    found = ngram_buckets(host, path, len(model.weights), model.sizes)
    weights = F.split(F.lit(",".join(map(repr, model.weights))), ",").cast("array<double>")  # folded to a constant
    bias = F.lit(model.bias)

    def logistic(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda s, k: s + F.get(weights, k))
        return 1.0 / (1.0 + F.exp(-(total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double")) + bias)))

    return _let(found, logistic)


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, model: UrlModel | None = None, threshold: float = 0.5
) -> DataFrame:
    """Every row's page_id, host, path, rule, verdict and score.

    The verdict is the longest fitting rule's; without one, ``allow`` if the
    classifier's score reaches the threshold, else ``block``.

    Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule
    and gets the classifier's verdict for empty parts. Repeated rows are judged one by one,
    other columns are ignored, an empty table gives no row.
    """
    model = model or train_url_model(pages.sparkSession)
    url = F.col("url")
    parts = pages.select("page_id", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    judged = parts.select(
        "*", best_rule(F.col("host"), F.col("path"), rules).alias("hit"), url_score(F.col("host"), F.col("path"), model).alias("score")
    )
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("hit.text").alias("rule"),
        F.coalesce("hit.action", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"),
        "score",
    )
