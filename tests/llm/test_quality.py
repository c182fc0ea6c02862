"""Quality rules: counts against plain Python, learned limits, and the pipeline."""

import random
from collections import Counter

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import prose
from tests.llm.test_dedup import ordered
from wiregrid.llm import quality_rules


def counted(text):
    text = text or ""
    words = brute.WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(repeated),
    )


def test_counts(nulls):
    found = quality_rules.judge(nulls, keep=["doc_id", "text"]).collect()
    assert len(found) == nulls.count()
    for r in found:
        told = counted(r.text)
        assert tuple(r[c] for c in quality_rules.COUNTS) == told
        assert r.base_failed == (told[0] < 50 or 100 * told[4] > 50 * told[0])
        assert not (r.kept and r.base_failed)


def quantile(values, thousandths):
    values = sorted(values)
    return next(v for k, v in enumerate(values, 1) if 1000 * k >= thousandths * len(values))


def cell(value):
    shift = max(value.bit_length() - 7, 0)
    return value >> shift << shift


def test_limits_of_language_and_source(spark):
    """Every verdict against limits worked out in plain Python, at all three levels."""
    draw, rows = random.Random(9), []
    for i in range(400):
        lang, source = draw.choice([("en", "a"), ("en", "b"), ("fr", "a"), (None, None), ("de", "c")])
        text = prose(i, 60)
        if draw.random() < 0.2:
            text = text.replace(" ", " ### ", draw.randint(0, 59))
        rows.append((i, text, lang if i % 50 else "xx", source))
    rules = quality_rules.Rules(min_rows=60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    verdicts = {r.doc_id: r.kept for r in quality_rules.judge(docs, rules).collect()}

    def ratios(text):
        n, chars, symbols, lines, repeats = counted(text)
        return {
            "word_length": chars * 100 // n, "symbols": symbols * 1000 // n,
            "dup_lines": lines * 1000 // n, "repeats": repeats * 1000 // n,
        }

    told = {i: ratios(t) for i, t, _, _ in rows}
    levels = [lambda r: (r[2], r[3]), lambda r: r[2], lambda r: 0]
    for row in rows:
        for level in levels:
            group = [r for r in rows if level(r) == level(row)]
            if len(group) >= 60:
                break
        fair = True
        for name, slack in rules.slack:
            cells = [cell(told[r[0]][name]) for r in group]
            low, mid, high = (quantile(cells, q) for q in (100, 500, 900))
            fair &= mid - 4 * (mid - low + slack) <= told[row[0]][name]
            fair &= told[row[0]][name] <= mid + 4 * (high - mid + slack)
        assert verdicts[row[0]] == fair
    assert 0 < sum(verdicts.values()) < 400


def test_few_rows_have_no_limits(spark, empty):
    docs = spark.createDataFrame(
        [(1, prose(1, 60) + " ###" * 50, "en", "a"), (2, "short", "en", "a")],
        "doc_id long, text string, lang string, source string",
    )
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()} == {1: True, 2: False}
    assert quality_rules.judge(empty).count() == 0


def test_added_columns_are_replaced(docs):
    found = quality_rules.judge(docs)
    assert len(found.columns) == len(set(found.columns))
    assert set(docs.columns) <= set(found.columns)


COLUMNS = "doc_id", "text", "lang", "source", "n_chars"


def test_pipeline_stages(spark, rows):
    """Each stage against a plain version over what the stage before it kept."""
    docs = spark.createDataFrame(
        [(*r, len(r[1] or "")) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    held = list(map(tuple, docs.collect()))
    by_name = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == list(by_name) and len(by_name) == 5
    quality, exact, near, passages, packing = by_name.values()

    made = quality(spark, docs, "")
    verdict = quality_rules.judge(docs).where("kept").select(*COLUMNS)
    assert made.columns == list(COLUMNS) and ordered(made.collect()) == ordered(verdict.collect())

    made = exact(spark, docs, "")
    keep = {(d, s) for d, _, _, kept, s in brute.exact([r[:2] for r in held]) if kept}
    expected = [r for r in held if (r[0], brute.sha(brute.SPACE.sub(" ", r[1] or ""))) in keep]
    assert made.columns == list(COLUMNS) and ordered(made.collect()) == ordered(expected)

    made = near(spark, docs, "")
    keep = {d for d, _, c in brute.near([r[:2] for r in held], 5) if c == d}
    assert ordered(made.collect()) == ordered(r for r in held if r[0] in keep)

    made = passages(spark, docs, "")
    texts = {d: k.decode("utf-8", "replace") for d, _, _, _, k in brute.byte_repeats([r[:2] for r in held])}
    assert made.columns == list(COLUMNS)
    for r in made.collect():
        assert (r.text or "").replace("�", "") == texts[r.doc_id].replace("�", "")
        assert r.text is None or r.n_chars == len(r.text)

    made = packing(spark, docs, "")
    assert {r.doc_id for r in made.collect()} == {r[0] for r in held}


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame(
        [], "doc_id long, text string, lang string, source string, n_chars long"
    )
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
