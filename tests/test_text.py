import html
import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from wiregrid.functions import ids, text, times


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(11)
    alphabet = "aB cé_9\t\n.-!İß中  📈&<>"
    return ["", " ", "word", *["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(300)]]


def test_truncate(spark, strings):
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    for limit in (0, 2, 3, 4, 10, 100):
        for s, v in df.select("s", text.truncate(F.col("s"), limit)).collect():
            expected = s if len(s) <= limit else s[:limit] if limit <= 3 else s[: limit - 3] + "..."
            assert v == expected
    assert one(spark, text.truncate(F.lit("hello world"), 8)) == "hello..."
    with pytest.raises(ValueError):
        text.truncate(F.lit("x"), -1)


def test_spaces_and_words_follow_unicode(spark, strings):
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    rows = df.select(
        "s", text.collapse_spaces(F.col("s")), text.strip(F.col("s")), text.words(F.col("s"))
    ).collect()
    for s, flat, bare, words in rows:
        assert flat == re.sub(r"\s+", " ", s).strip()
        assert bare == s.strip()
        if "İ" not in s:
            assert words == re.findall(r"\w+", s.lower())


def test_similarity(spark):
    rows = [("apple", "apple", 1.0), ("apple", "orange", 0.0), ("", "", 0.0), ("a b", "B c", 1 / 3)]
    df = spark.createDataFrame(rows, "a string, b string, e double")
    for a, b, e in [(r.x, r.y, r.e) for r in df.select(
        text.text_similarity(F.col("a"), F.col("b")).alias("x"),
        text.text_similarity(F.col("b"), F.col("a")).alias("y"), "e").collect()]:
        assert a == b == pytest.approx(e)


@pytest.mark.parametrize(
    "source, expected",
    [
        ("<b>Hello</b> <i>World</i>", "Hello World"),
        ("<b>Hello</b>World", "Hello World"),
        ("plain  text", "plain text"),
        ("Deal with AT&T", "Deal with AT&T"),
        ("S&amp;P &lt;b&gt; &copy; &eacute; &#8217; &amp;lt;", "S&P <b> © é ’ &lt;"),
        ("a < b", "a < b"),
        ("<!-- gone --><p class=\"x>y\">kept</p>", "kept"),
        ("<script>var t=\"</p>\" && 1;</script>end", "var t=\"</p>\" && 1; end"),
        ("<style>p{}</style>x<br>y", "p{} x y"),
        ("cut <a href", "cut"),
        ("", ""),
    ],
)
def test_clean_html(spark, source, expected):
    df = spark.createDataFrame([(source,)], "s string")
    assert df.select(text.clean_html(F.col("s"))).first()[0] == expected


def test_script_can_be_dropped(spark):
    df = spark.createDataFrame([("<script>x</script>y",)], "s string")
    assert df.select(text.clean_html(F.col("s"), drop_script=True)).first()[0] == "y"


def test_entities_equal_the_standard_decoder(spark):
    samples = ["&lt;&gt;", "&amp;amp;", "&AMP;", "&notit;", "&#x41;", "&frac12", "&bogus;", "&", "&nbsp;x"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for s, v in df.select("s", text.decode_entities(F.col("s"))).collect():
        assert v == html.unescape(s)


def test_slugify(spark, strings):
    df = spark.createDataFrame([(s,) for s in ["Hello World!", "  a_b--c ", *strings]], "s string")
    for s, v in df.select("s", text.slugify(F.col("s"))).collect():
        folded = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()
        words = re.sub(r"[\s_]+", "-", re.sub(r"[^\w\s-]", "", folded)).strip("-")
        assert v == words


def test_ids_and_times(spark):
    sample = ids.article_id(F.lit("AAPL"), F.lit("https://reuters.com/aapl"), F.lit(1700000000))
    assert one(spark, sample) == "f75a5218c68d2dec"
    for seconds in (0, 1, 1_700_000_000, -5, 4_000_000_000):
        back = times.timestamp_to_unix(times.unix_to_timestamp(F.lit(seconds)))
        assert one(spark, back) == seconds
    ts = F.lit("2024-03-05 07:08:09").cast("timestamp")
    assert one(spark, times.long_date(ts)) == "March 05, 2024"
    assert one(spark, times.minute_stamp(ts)) == "2024-03-05 07:08 UTC"
    assert one(spark, times.elapsed_ms(ts, ts + F.expr("interval 1500 milliseconds"))) == 1500
    assert one(spark, times.elapsed_ms(ts, F.lit(None).cast("timestamp"))) is None


def test_tags_of_many_attributes(spark):
    many = " ".join(f'a{i}="v>{i}"' for i in range(100_000))
    rows = [f"<p {many}>one</p> two", "<a href='x>y'>l</a><b title=\"open", "<!-- never closed <b>t</b>"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(text.clean_html(F.col("t"))).collect()]
    assert got[0] == "one two" and got[1] == "l" and got[2].endswith("t")


def test_markup_like_the_standard_parser(spark):
    """Well-formed random markup, as the standard library's parser reads it."""
    import random
    from html.parser import HTMLParser

    class Texts(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts = []

        def handle_data(self, data):
            self.parts.append(data)

    draw, rows = random.Random(6), []
    for _ in range(300):
        pieces = [
            draw.choice(
                ["word", " x y ", "&amp;", "&lt;b&gt;", "<b>", "</b>", "<br/>", '<a h="1>2" k=\'"\'>',
                 "<!-- c > d -->", "\n", "é", "<P CLASS=z>"]
            )
            for _ in range(draw.randint(1, 12))
        ]
        rows.append("".join(pieces))
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", text.clean_html(F.col("t"))).collect()}
    for i, row in enumerate(rows):
        parser = Texts()
        parser.feed(row)
        parser.close()
        assert got[i] == " ".join(" ".join(parser.parts).split()), row


def plain_clean(source):
    """A forward scan in plain Python."""
    out, i, low = [], 0, source.lower()
    letter = "abcdefghijklmnopqrstuvwxyz"

    def raw_at(i):
        for name in ("script", "style"):
            m = re.compile(rf"<{name}\b[^>]*>", re.I).match(source, i)
            if m:
                end = re.compile(rf"</{name}[^>]*>", re.I).search(source, m.end())
                if end:
                    return source[m.end():end.start()], end.end()
        return None

    def quoted_end(i):
        j = i + 2 if low[i + 1 : i + 2] == "/" else i + 1
        if low[j : j + 1] not in letter or j >= len(low):
            return None
        while j < len(source):
            if source[j] == ">":
                return j + 1
            if source[j] in "\"'":
                k = source.find(source[j], j + 1)
                if k < 0:
                    return None
                j = k
            j += 1
        return None

    while i < len(source):
        if source[i] != "<":
            k = source.find("<", i)
            k = len(source) if k < 0 else k
            out.append(html.unescape(source[i:k]))
            i = k
            continue
        end = source.find("-->", i + 4) if source.startswith("<!--", i) else -1
        raw = raw_at(i)
        if end >= 0:
            i = end + 3
        elif raw:
            out.append(raw[0])
            i = raw[1]
        elif quoted_end(i):
            i = quoted_end(i)
        elif low[i + 1 : i + 2] and low[i + 1] in letter + "/!?":
            k = source.find(">", i)
            i = len(source) if k < 0 else k + 1
        else:
            out.append("<")
            i += 1
    return " ".join(" ".join(out).split())


def test_random_markup_like_a_forward_scan(spark):
    draw = random.Random(19)
    bits = ["<", ">", "/", "!", "--", "a", "b ", "\"", "'", "<!--", "-->", "<script>", "</script>", "<script ",
            "</script", "<style x>", "</style>", "<a href=", "</p>", " ", "x=", "<b>", "&amp;", "é"]
    rows = ["".join(draw.choices(bits, k=draw.randint(1, 40))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").repartition(8)
    got = {r[0]: r[1] for r in df.select("i", text.clean_html(F.col("t"))).collect()}
    for i, row in enumerate(rows):
        assert got[i] == plain_clean(row), row


def test_what_is_left_open_is_read_once(spark):
    """A megabyte of openings without an end; a search from each would take minutes."""
    n = 1_000_000
    bits = ["<script>", "<script ", "<!--", "<style>x", '<a ">"', "<a '\">'", "<a \"", "</script", "<"]
    rows = [bit * (n // len(bit)) for bit in bits]
    rows += ["<script " * 60_000 + "</script>" + "y" * 500_000, "<!--" * 200_000 + "-->" + "z<!--" * 50_000]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").repartition(8)
    start = time.monotonic()
    got = df.select("i", F.char_length(text.clean_html(F.col("t")))).collect()
    assert len(got) == len(rows) and time.monotonic() - start < 60


def test_references_like_the_standard_decoder(spark):
    from html.entities import html5

    names = sorted(html5)
    samples = [f"x&{n} y" for n in names[::7]] + [f"&{n.rstrip(';')}zz;" for n in names[::11]]
    samples += [f"&#{n};" for n in [*range(0, 300), 0xD7FF, 0xD800, 0xFDD0, 0xFFFE, 0x1F642, 0x10FFFF, 0x110000]]
    samples += [f"a&#x{n:X}b" for n in (0x41, 0x80, 0x1FFFF, 0xE000)] + ["&#x;", "&#;", "&#0000000065;", "&#99999999999999999999;",
                "&#xFFFFFFFFFFFFFFFFFFFFF", "&&amp&lt", "&notin;&notit;&no;", "&" * 50, "&" + "q" * 50 + ";", "&#65 &#x42"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for s, v in df.select("s", text.decode_entities(F.col("s"))).collect():
        assert v == html.unescape(s), s


def test_normalising_needs_no_python(spark):
    from wiregrid.operators.normalize import normalize

    raw = spark.createDataFrame([("A", 0, "{}", 0)], "ticker string, batch_pos int, raw_json string, seq long")
    plan = normalize(raw).articles._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
