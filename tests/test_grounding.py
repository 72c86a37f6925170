import re
from urllib.parse import urlparse

from deskflow.functions import fixed_values as fv
from deskflow.functions import urls
from deskflow.operators.grounding import build_whitelist, ground, grounding_summary


def check(spark, corpus, reply):
    c = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "tweet_id bigint, text string")
    r = spark.createDataFrame([(1, reply)], "tweet_id bigint, reply string")
    return ground(r, build_whitelist(c)).first()


def test_sibling_of_a_listed_path_is_flagged(spark):
    listed, sibling = "https://docs.shop.test/orders/track", "https://docs.shop.test/orders/erase"
    row = check(spark, [f"orders: {listed}"], f"{listed} or {sibling}")
    assert not row.passed and row.violations == [sibling]
    assert row.clean_reply == f"{listed} or {fv.REMOVED_URL_TEXT}"


def test_slash_query_and_fragment_do_not_matter(spark):
    for written in ("https://docs.shop.test/faq/", "https://docs.shop.test/faq?lang=de", "https://docs.shop.test/faq/#top"):
        assert check(spark, ["https://docs.shop.test/faq"], f"> {written}").passed


def test_shortener_is_trusted_as_it_is_spelt(spark):
    assert check(spark, [""], "https://t.co/Q9q").passed
    assert not check(spark, [""], "https://T.CO/Q9q").passed


def test_host_alone_lists_only_itself(spark):
    corpus = ["our page: https://shop.test"]
    # For a bare host the scheme does not matter, for a path it does.
    assert check(spark, corpus, "http://shop.test/ it is").passed
    assert not check(spark, corpus, "https://shop.test/refunds/now").passed
    assert not check(spark, ["https://shop.test/b"], "http://shop.test/b").passed


def test_reply_without_links_passes(spark):
    row = check(spark, [None, ""], None)
    assert row.passed and row.violations == [] and row.violation_urls == ""


def test_duplicates_order_and_longest_first(spark):
    row = check(spark, [""], "a https://h/x b https://h/xy c https://h/x")
    assert row.violations == ["https://h/x", "https://h/xy", "https://h/x"]
    assert row.clean_reply == "a {0} b {0} c {0}".format(fv.REMOVED_URL_TEXT)
    assert row.violation_urls == "https://h/x; https://h/xy; https://h/x"


def test_short_violation_inside_a_listed_url(spark):
    # Plain replacement also hits a listed longer URL; that is the defined behaviour.
    row = check(spark, ["https://h/xy"], "https://h/x and https://h/xy")
    assert row.clean_reply == f"{fv.REMOVED_URL_TEXT} and {fv.REMOVED_URL_TEXT}y"


URLS = [
    "https://h.com/a|b", "http://u:p@H.com:80/A/b;p=1?q#f", "https://h.com", "https://h.com/", "https://h.com//",
    "https://h.com?x=/y", "https://h.com#/y", "https://h/a;b/c;d;e", "https://h/;x", "https://h/a/;p/", "http:///x",
]


def test_url_parts_match_python(values):
    parsed = [urlparse(u) for u in URLS]
    assert values(urls.url_scheme, URLS) == [p.scheme for p in parsed]
    assert values(urls.url_host, URLS) == [p.netloc for p in parsed]
    assert values(urls.url_path, URLS) == [p.path.rstrip("/") for p in parsed]


def test_extraction_matches_python(values):
    texts = ["a https://x.y/z,\"http://q'r <https://s>t\xa0https://u　v http:/no HTTPS://NO https://", None]
    assert values(urls.extract_urls, texts) == [re.findall(fv.REPLY_URL_PATTERN, texts[0]), []]


def test_one_link_in_most_replies(spark):
    """A link that fills the table still gives every reply its own result."""
    n = 3000
    r = spark.range(n).selectExpr(
        "id AS tweet_id", "IF(id % 3 > 0, 'see https://hot/x', concat('see https://h/', id)) AS reply"
    )
    c = spark.createDataFrame([(1, "https://h/0 https://h/3")], "tweet_id bigint, text string")
    whitelist = build_whitelist(c)
    row = grounding_summary(ground(r, whitelist), whitelist).first()
    assert (row.replies, row.violations, row.passed, row.whitelist_entries) == (n, n - 2, 2, 2)


def test_whitelist_passes_its_own_corpus(spark):
    c = spark.createDataFrame(list(enumerate(URLS)), "tweet_id bigint, text string")
    own = ground(c.withColumnRenamed("text", "reply"), build_whitelist(c))
    assert own.where("NOT passed").count() == 0
