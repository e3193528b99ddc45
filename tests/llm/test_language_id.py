"""Language identification: held-out accuracy, evidence, edge cases."""

import math
import random

import numpy as np

from paperloom.llm.language_id import Plan, identify, trigram_runs, trigrams
from paperloom.llm.html_text import language_tag, visible_text
from paperloom.llm.queries import op5_language_id, op5_page_language

FOLDER = "/root/testdata/sf0.01"
SYLLABLES = {
    "en": "th er on an in ing and the".split(),
    "de": "sch ung ein er lich keit der die".split(),
    "fr": "eau eux oi que ment tion le les".split(),
    "es": "ción ado os la que ie rr los".split(),
}
FIVE = {**SYLLABLES, "it": "zza gli che ono sce ucci".split()}


def text_in(language, draw, words=40):
    some = FIVE[language]
    return " ".join("".join(draw.choices(some, k=draw.randrange(1, 4))) for _ in range(words))


def test_query_tells_declared_languages(spark):
    rows = op5_language_id(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert sum(r.language == r.declared for r in rows) >= 0.98 * len(rows)
    assert sum(r.kept for r in rows) >= 0.99 * len(rows)


def test_text_alone_on_documents_without_declaration(spark):
    draw = random.Random(1)
    truth, rows = {}, []
    for i in range(400):
        truth[i] = draw.choice(list(SYLLABLES))
        declared = truth[i] if i < 300 else None
        rows.append((i, text_in(truth[i], draw), declared, "h"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    unseen = [r for r in identify(frame).collect() if r.doc_id >= 300]
    assert sum(r.text_language == truth[r.doc_id] for r in unseen) >= 0.97 * len(unseen)


def test_host_and_suffix_decide_where_text_does_not(spark):
    draw = random.Random(2)
    rows = []
    for i in range(300):
        language = "de" if i % 2 else "es"
        host = f"h{i % 6}.{'haus.de' if language == 'de' else 'casa.es'}"
        rows.append((i, text_in(language, draw), language, host))
    rows += [(1000, "x qq", None, "new.haus.de"), (1001, "x qq", None, "new.casa.es")]
    rows += [(1002, "x qq", None, "other.es")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in identify(frame).collect()}
    assert got[1000].language == "de" and got[1001].language == "es"
    from pyspark.sql import functions as F

    last = F.substring_index("source", ".", -1)
    got = {r.doc_id: r for r in identify(frame, host=None, suffix=last).collect()}
    assert got[1000].language == "de" and got[1002].language == "es"


def test_texts_of_no_language_are_rejected(spark):
    draw = random.Random(3)
    rows = [(i, text_in(list(SYLLABLES)[i % 4], draw), list(SYLLABLES)[i % 4], "h") for i in range(400)]
    rows += [(900, "漢字仮名交じり文を書く" * 30, None, "h"), (901, "xqzj wvkq zzxj qqkv " * 30, None, "h")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in identify(frame).collect()}
    assert not got[900] and not got[901]
    assert sum(got[i] for i in range(400)) >= 398


def test_edge_cases(spark):
    rows = [
        (1, None, None, None), (2, "", "en", "h"), (3, "123 !!", "en", "h"), (4, "the thing", None, None),
        (4, "the thing", None, None), (None, "the thing", "xx", "h"), (5, "the thing " * 30_000, "EN", "h"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame = frame.selectExpr("*", "1 as likely", "2 as kept", "3 as host")
    got = identify(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.language, r.probability, r.kept) == (None, None, False)
        else:
            assert r.language == "en" and 0 < r.probability <= 1
    assert identify(frame.limit(0)).count() == 0


def test_trigrams_stay_within_their_text():
    whole, owner = trigrams(["ab", None, "Cd é"], 15)
    alone = [trigrams([t], 15)[0].tolist() for t in ("ab", None, "cd É")]
    assert [whole[owner == k].tolist() for k in range(3)] == alone
    assert isinstance(Plan(), tuple) and whole.dtype == np.int64


def test_long_texts_are_counted_in_parts():
    texts = ["ab cd", "the thing İ " * 40, None, "", "xyz" * 30]
    for chars in (7, 50, 10_000):
        got = [[] for _ in texts]
        for first, last, parts in trigram_runs(texts, 15, chars):
            for hashed, owner in parts:
                for h, o in zip(hashed.tolist(), owner.tolist()):
                    assert first + o < last
                    got[first + o].append(h)
        assert got == [trigrams([t], 15)[0].tolist() for t in texts]


def posterior_by_hand(rows, plan):
    """[(language, probability)] of (text, declared, host) rows, hosts of one label."""

    def threes(text):
        plain = [c if c >= "\u00c0" or "a" <= c <= "z" else " " for c in f" {(text or '').lower()} "]
        for a, b, c in zip(plain, plain[1:], plain[2:]):
            if sum(x != " " for x in (a, b, c)) >= 2:
                word = ord(a) << 42 ^ ord(b) << 21 ^ ord(c)
                yield (word * 0x9E3779B97F4A7C15 % 2**64) >> (64 - plan.bits)

    def logs(counts, added):
        total = sum(counts) + added * len(counts)
        return [math.log((n + added) / total) for n in counts]

    names = plan.languages
    counts = {x: [0] * 2**plan.bits for x in names}
    for text, declared, _ in rows:
        for bucket in threes(text) if declared in names else ():
            counts[declared][bucket] += 1
    table = {x: logs(counts[x], plan.added) for x in names}
    likely = [[sum(table[x][b] for b in threes(text)) for x in names] for text, _, _ in rows]
    best = [
        max(range(len(names)), key=lambda k: sums[k]) if any(threes(text)) else None
        for sums, (text, _, _) in zip(likely, rows)
    ]
    told = [(b, d, h) for b, (_, d, h) in zip(best, rows) if b is not None]
    prior = [sum(b == k for b, _, _ in told) + 1 for k in range(len(names))]
    prior = [n / sum(prior) for n in prior]
    given = [logs([sum((b, d) == (k, x) for b, d, _ in told) for x in names], 1) for k in range(len(names))]
    out = []
    for sums, b, (text, declared, host) in zip(likely, best, rows):
        if b is None:
            out.append((None, None))
            continue
        at_host = [sum((k, host) == (x, h) for x, _, h in told) for k in range(len(names))]
        score = [
            plan.weight * sums[k]
            + (given[k][names.index(declared)] if declared in names else 0)
            + math.log((at_host[k] + plan.pull * prior[k]) / (sum(at_host) + plan.pull))
            for k in range(len(names))
        ]
        top = max(score)
        out.append((names[score.index(top)], 1 / sum(math.exp(x - top) for x in score)))
    return out


def test_posterior_equals_the_plain_computation_in_any_order(spark):
    draw = random.Random(9)
    plan = Plan(languages=("de", "en"), bits=10)
    rows = [("", None, "a"), ("12 34", None, "b"), (None, "de", "a"), ("th", "xx", "a"), ("é", None, None)]
    rows += [("The thing. und", None, "b"), ("x qq", None, "c"), ("the " * 400, "de", "a")]
    for i in range(60):
        language = draw.choice(["de", "en"])
        rows.append((text_in(language, draw, 3), language if i % 3 else None, draw.choice("abc")))
    want = posterior_by_hand(rows, plan)
    for seed in range(3):
        order = list(range(len(rows)))
        random.Random(seed).shuffle(order)
        frame = spark.createDataFrame(
            [(i, *rows[i]) for i in order], "doc_id long, text string, lang string, source string"
        )
        got = {r.doc_id: r for r in identify(frame.coalesce(1), plan).collect()}
        for i, (language, probability) in enumerate(want):
            assert got[i].language == language
            if language:
                assert abs(got[i].probability - probability) < 1e-9
        assert not any(got[i].kept for i in (0, 1, 2))


def test_languages_are_those_declared(spark):
    draw = random.Random(6)
    rows = [(i, text_in(x, draw), x, "h") for i in range(60) for x in FIVE]
    rows += [(900 + i, text_in("it", draw), None, "h") for i in range(10)] + [(999, "the thing", "qq", "h")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = identify(frame).collect()
    assert {r.language for r in got} == set(FIVE)
    assert all(r.language == "it" and r.kept for r in got if 900 <= r.doc_id < 910)
    nothing = identify(frame.withColumn("lang", frame["lang"].substr(9, 1))).collect()
    assert len(nothing) == len(rows) and not any(r.kept for r in nothing)


def test_every_page_is_identified(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    rows = op5_page_language(spark, FOLDER).collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in pages.collect())
    declared = [r for r in rows if r.declared]
    assert len(declared) >= 0.9 * len(rows)
    assert sum(r.language == r.declared for r in declared) >= 0.97 * len(declared)


def test_pages_take_language_from_host_and_suffix(spark, tmp_path):
    draw = random.Random(4)
    page = "<html%s><script>the thing and the thing</script><p>%s</p></html>"
    rows = []
    for i in range(300):
        language = "de" if i % 2 else "es"
        site = "a.b.haus.de" if language == "de" else "a.b.casa.es"
        text = text_in(language, draw)
        rows.append((i, f"http://w{i % 6}.{site}/x", page % (f' lang="{language}-XX"', text)))
    rows += [(1000, "https://u@New.b.Haus.de:80/?x", page % ("", "x qq"))]
    rows += [(1001, "http://new.casa.es./", page % ("", "x qq")), (1002, "http://other.es", page % ("", "x qq"))]
    rows += [(1003, None, None), (1004, "http://1.2.3.4/", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in op5_page_language(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[1].declared == "de" and got[1000].declared is None
    assert [got[i].language for i in (1000, 1001, 1002)] == ["de", "es", "es"]
    assert got[1003].language is None and got[1004].language is None


def test_text_and_language_of_markup():
    page = '<!-- <html lang="xx"> --><HTML class=a LANG=fr-CA><style>p</style><a t=">">d&eacute;j&agrave;</a> 1 < 2<script>x'
    assert language_tag(page) == "fr" and visible_text(page).split() == ["déjà", "1", "<", "2"]
    assert language_tag('<html hreflang="de">') is None and language_tag("lang=de") is None
