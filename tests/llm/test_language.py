import math
import random
from collections import Counter

import numpy as np

from lodestream.llm import language
from lodestream.llm.textblock import pieces


def test_trigrams_stay_inside_texts():
    import pyarrow as pa

    texts = ["abc", "", "ab", "abcd", "xyzabc", None, "é"]
    _, _, data, off = next(pieces(pa.array(texts)))
    cells, at = language.trigrams(data, off)
    sizes = [max(0, len((t or "").encode()) - 2) for t in texts]
    assert np.diff(at).tolist() == sizes
    assert cells[at[0]] == cells[at[3]] == cells[at[5] - 1]


def test_accuracy_and_fusion(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.apply(docs, "doc_id", "text", "lang", "source").collect()
    assert len(out) == docs.count()
    assert sum(r.lang == r.declared for r in out) / len(out) > 0.98
    assert sum(r.text_lang == r.declared for r in out) / len(out) > 0.95
    assert all(0 < r.probability <= 1 for r in out)


def rows():
    out = [(i, "the cat and the dog are in the house with the bird", "en", f"h{i % 3}.site.com", "com") for i in range(40)]
    out += [(100 + i, "der hund und die katze sind nicht im haus mit dem vogel", "de", f"h{i % 2}.seite.de", "de") for i in range(40)]
    return out


def test_priors_decide_where_the_text_is_silent(spark):
    more = [(200, "", None, "h0.seite.de", "de"), (201, None, None, "new.seite.de", "de"), (202, "", None, "other.site.com", "com"), (203, "", "de", None, None), (204, "", None, None, None), (205, "der hund und die katze sind im haus", "en", "h0.site.com", "com"), (200, "", None, "h0.seite.de", "de"), (None, "the dog", "xx", "a", None)]
    df = spark.createDataFrame(rows() + more, "id long, text string, declared string, host string, suffix string").selectExpr("*", "1 as p", "2 as ll", "'x' as prior")
    out = language.apply(df, "id", "text", "declared", "host", "suffix").collect()
    assert len(out) == 88
    by = {r.id: r for r in out}
    assert (by[200].lang, by[202].lang, by[203].lang) == ("de", "en", "de")
    assert by[205].text_lang == "de"
    assert by[204].lang in ("de", "en") and by[201].lang is not None
    assert by[200].text_lang is None


def test_without_declarations_or_rows(spark):
    df = spark.createDataFrame(rows(), "id long, text string, declared string, host string, suffix string")
    assert {r.lang for r in language.apply(df, "id", "text").collect()} == {None}
    assert language.apply(df.limit(0), "id", "text", "declared", "host", "suffix").collect() == []


def test_every_declared_language_counts(spark):
    """Each of 90 languages has words of its own, and the rarest have the fewest rows."""
    out = []
    for k in range(90):
        words = " ".join(chr(0x4E00 + 40 * k + j) * 3 for j in range(12))
        out += [(1000 * k + i, words, f"l{chr(97 + k // 26)}{chr(97 + k % 26)}") for i in range(3 if k < 70 else 2)]
    df = spark.createDataFrame(out, "id long, text string, declared string").repartition(3)
    got = language.apply(df, "id", "text", "declared").collect()
    assert len(got) == len(out) and len({r.text_lang for r in got}) == 90
    assert all(r.text_lang == r.lang == r.declared for r in got)


def plain(rows, n_smooth=language.SMOOTH):
    """The posterior of every row by loops over all the other rows: counts, shares and sums without the row itself."""

    def cells(text):
        b = (text or "").lower().encode()
        return [(((b[i] * 0x9E3779B1) & 0xFFFFFFFF) ^ ((b[i + 1] * 0x85EBCA77) & 0xFFFFFFFF) ^ ((b[i + 2] * 0xC2B2AE3D) & 0xFFFFFFFF)) >> 17 for i in range(len(b) - 2)]

    told = [(d or "").lower().split("-")[0] or None for _, _, d, _, _ in rows]
    langs = sorted({d for d in told if d})
    grams = [cells(t) for _, t, _, _, _ in rows]
    ps, lls = [], []
    for i in range(len(rows)):
        score = []
        for lang in langs:
            seen = [c for j in range(len(rows)) if told[j] == lang and j != i for c in grams[j]]
            held = Counter(seen)
            score.append(sum(math.log((held[c] + 0.5) / (len(seen) + 0.5 * language.CELLS)) for c in grams[i]))
        ll = [max(language.TEMPER * (x - max(score)), -language.MAX_EVIDENCE) for x in score]
        lls.append(ll)
        ps.append([math.exp(x) / sum(map(math.exp, ll)) for x in ll])
    places = []
    for _, _, _, host, suffix in rows:
        host, suffix = host and host.lower(), suffix and suffix.lower()
        parts = (host or "").split(".")
        domain = ".".join(parts[-2:]) if len(parts) > 1 and all(parts[-2:]) else None
        places.append([(), suffix, domain and (domain, suffix), host and (host, suffix)])
    out = []
    for i in range(len(rows)):
        others = [j for j in range(len(rows)) if j != i]
        prior = [1 / len(langs)] * len(langs)
        for level in range(4):
            if places[i][level] is not None:
                here = [ps[j] for j in others if places[j][level] == places[i][level]]
                prior = [(sum(p[k] for p in here) + n_smooth * prior[k]) / (len(here) + n_smooth) for k in range(len(langs))]
        z = []
        for k in range(len(langs)):
            d = 0.0
            if told[i]:
                same, any_ = (sum(ps[j][k] for j in others if ok(told[j])) for ok in (lambda x: x == told[i], bool))
                d = math.log((same + n_smooth / len(langs)) / (any_ + n_smooth))
            z.append(lls[i][k] + d + math.log(prior[k]))
        total = sum(math.exp(x - max(z)) for x in z)
        out.append((rows[i][0], langs[z.index(max(z))], 1 / total, langs[lls[i].index(0.0)] if len(rows[i][1] or "") > 2 else None))
    return out


def test_equals_loops_over_the_other_rows(spark):
    r = random.Random(3)
    words = {"en": "the cat and dog house bird".split(), "de": "der hund und die katze vogel".split(), "fr": "le chat et la maison oiseau".split()}
    made = []
    for i in range(70):
        lang = r.choice(sorted(words))
        text = " ".join(r.choice(words[lang if r.random() < 0.85 else r.choice(sorted(words))]) for _ in range(r.choice([0, 1, 2, 5, 12])))
        suffix = r.choice([None, "com", lang])
        host = r.choice([None, "a", f"h{r.randrange(3)}.site.{suffix or 'net'}", "h1.Other.com"])
        made.append((i, r.choice([text, text, text, None]), r.choice([lang, lang, lang.upper() + "-x", None, "", r.choice(sorted(words))]), host, suffix))
    made += [(70, "x" * 20_000, "fr", "alone.org", "org"), (71, "ab", "en", None, None), (72, "the", "it", "h1.site.com", "com")]
    df = spark.createDataFrame(made, "id long, text string, declared string, host string, suffix string").repartition(3)
    got = {x.id: x for x in language.apply(df, "id", "text", "declared", "host", "suffix").collect()}
    assert len(got) == len(made)
    for i, lang, probability, text_lang in plain(made):
        assert abs(got[i].probability - probability) < 1e-9, i
        assert (got[i].lang, got[i].text_lang) == (lang, text_lang), i


def test_no_row_is_evidence_for_itself(spark):
    """Whatever a row alone with its declaration and at its host declares, its words do not become that language's."""
    for alone in ("de", "xx"):
        more = [(300, "the cat and the dog are in the house with the bird", alone, "alone.net", "net")]
        df = spark.createDataFrame(rows() + more, "id long, text string, declared string, host string, suffix string")
        out = {x.id: x for x in language.apply(df, "id", "text", "declared", "host", "suffix").collect()}
        assert (out[300].text_lang, out[300].lang) == ("en", "en")
