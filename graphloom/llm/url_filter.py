"""URL filters: rules first, then logistic regression on character n-grams.

A URL's host and path are cut out with native expressions. A rule is a host and
a path prefix; it fits the host and its subdomains, and the longest fitting rule
decides. URLs without a rule are judged by a logistic regression on hashed
character n-grams of host and path, trained here on a small labelled table by
full-batch gradient descent, which gives the same weights on every run.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is judged like any other; a null id is carried along, repeated
rows are judged each; URLs of any length are taken whole; an empty table gives no
rows; the result has the id and its own columns only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# The rules of the production query, as (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# The labelled table, URLs without their scheme. Hosts are well known ones, or made up and without a top-level domain.
BLOCKED = """
pornhub.com/video xvideos.com/tags/hot xhamster.com/videos redtube.com/adult youporn.com/category/teen chaturbate.com/cams onlyfans.com/nude
brazzers.com/scenes livejasmin.com/girls stripchat.com/cams adultfriendfinder.com/sex free-porn-tube/videos hot-sex-cams/live
xxx-movies/porn/free milf-sex/photos nude-celebs/gallery escort-girls/london hentai-manga/xxx
bet365.com/sports pokerstars.com/poker 888casino.com/slots betfair.com/betting williamhill.com/bet partypoker.com/bonus ladbrokes.com/betting
draftkings.com/casino best-casino-bonus/free-spins online-slots/jackpot mega-casino/roulette sports-betting-tips/odds
lucky-poker-room/bonus free-bets/football casino-royale/blackjack bingo-win/jackpot
buy-viagra-online/cheap cheap-cialis/pills online-pharmacy-rx/buy/viagra diet-pills-now/weight-loss
no-prescription-meds/order cheap-tramadol/buy steroids-shop/order canadian-pharmacy/cheap-pills
fast-payday-loans/apply instant-cash-loan/payday bad-credit-loans/cash forex-millionaire/profit
crypto-doubler/bitcoin get-rich-quick/money earn-money-fast/cash binary-options-profit/trade
thepiratebay.org/torrent 1337x.to/torrent rarbg.to/torrents kickasstorrents.to/movies torrent-movies/download
free-crack-download/keygen warez-world/serial full-version-crack/download nulled-scripts/download keygen-serial/crack
cheap-replica-watches/rolex fake-rolex/replica replica-handbags/cheap louis-vuitton-outlet/cheap
buy-backlinks/seo cheap-seo-links/backlinks buy-instagram-followers/cheap link-farm/seo/links
malware-host/exploit.exe free-virus-scan/download.exe phishing-login/paypal/verify secure-bank-login/verify-account
account-verify/login/update hack-facebook/password spyware-free/exploit win-free-iphone/prize claim-your-prize/winner
""".split()
ALLOWED = """
en.wikipedia.org/wiki/Mathematics de.wikipedia.org/wiki/Berlin fr.wikipedia.org/wiki/Paris es.wikipedia.org/wiki/Madrid commons.wikimedia.org/wiki/Main_Page
github.com/torvalds/linux gitlab.com/explore docs.python.org/3/library stackoverflow.com/questions/11227809 developer.mozilla.org/en-US/docs
doc.rust-lang.org/book kernel.org/doc apache.org/licenses spark.apache.org/docs/latest debian.org/releases ubuntu.com/download www.gnu.org/software
www.bbc.co.uk/news/world www.theguardian.com/uk/sport nytimes.com/2021/03/14/science washingtonpost.com/politics reuters.com/business apnews.com/hub/climate
lemonde.fr/international elpais.com/cultura spiegel.de/wissenschaft zeit.de/gesellschaft asahi.com/articles corriere.it/esteri
www.cnn.com/travel aljazeera.com/news economist.com/finance bloomberg.com/markets ft.com/companies wsj.com/articles npr.org/sections/health
mit.edu/research www.ox.ac.uk/admissions essex.ac.uk/courses stanford.edu/about harvard.edu/academics ethz.ch/en/studies berkeley.edu/news
nature.com/articles/s41586 sciencemag.org/journal arxiv.org/abs/1706.03762 pubmed.ncbi.nlm.nih.gov/31978945 plos.org/biology jstor.org/stable/2709
nasa.gov/missions/mars noaa.gov/weather cdc.gov/flu who.int/health-topics nhs.uk/conditions europa.eu/legislation un.org/en/about gov.uk/browse/tax
usa.gov/benefits parliament.uk/business congress.gov/bill loc.gov/collections census.gov/data bundestag.de/ausschuesse
google.com/search mail.google.com/mail maps.google.com/maps youtube.com/watch microsoft.com/en-us/windows apple.com/mac support.apple.com/en-gb
amazon.com/books ebay.co.uk/sch ikea.com/gb/en etsy.com/shop walmart.com/grocery target.com/home costco.com/furniture
facebook.com/events twitter.com/status linkedin.com/jobs reddit.com/r/gardening medium.com/@writer instagram.com/p pinterest.com/pin tumblr.com/tagged
imdb.com/title/tt0111161 rottentomatoes.com/m goodreads.com/book/show spotify.com/playlist netflix.com/title allmusic.com/album
tripadvisor.com/Hotel booking.com/hotel airbnb.com/rooms lonelyplanet.com/spain expedia.com/flights nationalgeographic.com/animals
allrecipes.com/recipe/soup bbcgoodfood.com/recipes epicurious.com/recipes food.com/recipe/bread webmd.com/diet mayoclinic.org/diseases
espn.com/football fifa.com/worldcup premierleague.com/clubs nba.com/games olympics.com/en/sports cricinfo.com/series
weather.com/forecast accuweather.com/gb openstreetmap.org/relation archive.org/details gutenberg.org/ebooks/1342 britannica.com/science
www.city-library/catalogue blog.garden-notes/roses forum.old-cars/questions m.news-paper/fr/monde www.school/timetable
museum/collection letters/1890/index.html www.orchestra/concerts physics.university/courses help.editor/en/faq
""".split()
PRIOR = 0.35  # share of URLs to be blocked that is assumed


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def best_rule(h: Column, p: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rule_host) | h.endswith(f".{rule_host}")) & p.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(hosts: Sequence[str], paths: Sequence[str], sizes: Sequence[int] = (3, 4, 5), bits: int = 18) -> tuple[np.ndarray, np.ndarray]:
    """(URL, slot) of the different n-grams of ``^host$`` and ``^path$``, host and path apart.

    The last label of a host with several, mostly a top-level domain, is left out.
    """
    out = [np.zeros(0, np.int64)]
    for kind, texts in enumerate(([h.rpartition(".")[0] or h for h in hosts], paths)):
        raw = [f"^{t}$".encode("utf-8", "surrogatepass") for t in texts]
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        owner, left = np.repeat(np.arange(len(raw)), size), np.repeat(np.cumsum(size), size) - np.arange(len(flat))
        h = np.full(len(flat), kind + 1, np.uint64)
        for k in range(max(sizes)):
            h = (h[: len(flat) - k] ^ flat[k:]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if k + 1 in sizes:
                at = np.flatnonzero(left[: len(h)] > k)
                out.append(owner[at] << bits | (h[at] >> np.uint64(64 - bits)).astype(np.int64))
    both = np.unique(np.concatenate(out))
    return both >> bits, both & ((1 << bits) - 1)


def split_url(url: str) -> tuple[str, str]:
    """Host and path of a labelled URL without scheme."""
    h, slash, p = url.partition("/")
    return h.lower(), slash + p.partition("?")[0].partition("#")[0]


def train(labelled: Sequence[tuple[str, int]], bits: int = 18, rounds: int = 400, rate: float = 1.0, decay: float = 3e-3, prior: float = PRIOR) -> np.ndarray:
    """Weights and, last, the bias; label 1 means block.

    Only n-grams of two or more labelled hosts get a weight, so that what is
    particular to a known host counts neither for nor against an unknown one. Both
    labels weigh the same in training; the bias is then moved to the share
    ``prior`` of URLs to block.
    """
    w = np.zeros((1 << bits) + 1)
    y = np.array([l for _, l in labelled], float)
    if not 0 < y.sum() < len(y):
        return w
    hosts, paths = zip(*(split_url(u) for u, _ in labelled))
    owner, slot = features(hosts, paths, bits=bits)
    names = np.unique(hosts, return_inverse=True)[1]
    known = np.bincount(np.unique(slot * len(hosts) + names[owner]) // len(hosts), minlength=1 << bits) > 1
    owner, slot = owner[known[slot]], slot[known[slot]]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(rounds):
        z = np.bincount(owner, w[slot], len(y)) + w[-1]
        g = (1 / (1 + np.exp(-z)) - y) * weight
        w[:-1] -= rate * (np.bincount(slot, g[owner], 1 << bits) + decay * w[:-1])
        w[-1] -= rate * g.sum()
    w[-1] += np.log(prior / (1 - prior))
    return w


def default_labels() -> list[tuple[str, int]]:
    """The labelled table; each host also with paths that say nothing."""
    out = []
    for label, urls in ((1, BLOCKED), (0, ALLOWED)):
        for k, u in enumerate(urls):
            host = u.partition("/")[0]
            out += [(u, label), (f"{host}/", label), (f"{host}/{('en', 'fr', 'de', 'es')[k % 4]}/{1009 * (k + 1)}{'.html' * (k % 2)}", label)]
    return out


def score(w: np.ndarray, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    """Probability that each URL is to be blocked."""
    owner, slot = features(hosts, paths, bits=(len(w) - 1).bit_length() - 1)
    return 1 / (1 + np.exp(-(np.bincount(owner, w[slot], len(hosts)) + w[-1])))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row; a score where no rule decides.

    The weights are 2**18 numbers, whatever the input.
    """
    weights = pages.sparkSession.sparkContext.broadcast(train(default_labels() if labelled is None else labelled))

    @F.pandas_udf("double")
    def blocked(h: pd.Series, p: pd.Series) -> pd.Series:
        out = np.full(len(h), np.nan)
        ask = np.flatnonzero(h.notna())
        size = np.cumsum((h.str.len() + p.str.len()).to_numpy(float)[ask])
        for some in np.split(ask, np.searchsorted(size, np.arange(1 << 20, size[-1] if len(size) else 0, 1 << 20))):
            out[some] = score(weights.value, h.iloc[some].tolist(), p.iloc[some].tolist())
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    rows = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rows = rows.select("id", "host", "path", best_rule(F.col("host"), F.col("path"), rules).alias("r"))
    open_host, open_path = (F.when(F.col("r").isNull(), F.col(c)) for c in ("host", "path"))
    rows = rows.withColumn("score", blocked(open_host, open_path))
    by_model = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", by_model).alias("verdict"), "score")
