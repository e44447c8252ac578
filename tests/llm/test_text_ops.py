"""Classifiers, tokenizers, packing and extraction on small tables."""

import math
import random
import re
import textwrap
import zlib

import numpy as np
import pytest

from tessera.llm import html_extract, license_scan, packing, quality, sentencepiece_codec, toxicity
from tessera.llm.queries import tokenizer_file

CLEAN = "the river runs past the old mill and the town sleeps under a pale moon while bells ring softly"


def corpus(spark, n=300):
    rng = random.Random(8)
    words = CLEAN.split() + [f"noun{k}" for k in range(200)]
    docs, labels = [], []
    for k in range(n):
        sents = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 15))).capitalize() + "." for _ in range(rng.randint(1, 30))]
        bad, toxic = k % 4 == 0, k % 3 == 0
        if bad:
            sents = [s.upper().replace(" ", "!! ") for s in sents] if k % 8 else [w + " " + w + " " + w for s in sents for w in s.split()]
        if toxic:
            sents.insert(rng.randrange(len(sents) + 1), "You are a vilestem" + rng.choice("abcdef") + " indeed.")
        docs.append((k, "\n".join(sents), "en", k))
        labels.append((k, int(not bad), int(toxic)))
    docs += [(n, None, None, 0), (n + 1, "", "en", 0), (n + 2, "x" * 300_000, "en", 0), (n + 3, "a " * 100_000, "en", 0)]
    labels += [(n, None, None), (n + 1, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def labelled(spark):
    return corpus(spark)


def accuracy(scored, labels, column):
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    held = [r for r in scored.collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])


def test_quality_held_out(labelled):
    docs, labels = labelled
    got = quality.score(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert accuracy(got, labels, "quality") > 0.95


def test_quality_counts_capitals_of_the_whole_text():
    at = quality.FEATURES.index("upper")
    text = "aB" * 40 + " " + "éÉ" * 7 + " words"
    for t in (text, "x" + text, "aB cD " * 30, " aB cD " * 30):
        chars = sum(map(len, t.split())) + 5 * quality.PLAIN
        assert quality.statistics(t)[at] == pytest.approx((sum(map(str.isupper, t)) / chars) ** 0.5)


def test_quality_without_labels(spark, labelled):
    got = quality.score(labelled[0], spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in got.collect()} == {0.5}


def test_quality_ignores_held_out_labels(spark, labelled):
    docs, labels = labelled
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    assert sorted(map(tuple, quality.score(docs, labels).collect())) == sorted(map(tuple, quality.score(docs, flipped).collect()))


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(500, 3)), rng.normal(size=(300, 3)) * 2 + 1
    sums = {c: (float(len(x)), x.sum(0), x.T @ x) for c, x in ((0, a), (1, b))}
    got = quality.Discriminant(sums, shrink=0.0, ridge=0.0).score(a[:20])
    logs = []
    for x in (a, b):
        cov = np.cov(x.T, bias=True)
        s = 3 / (3 + len(x))
        pooled = (len(a) * np.cov(a.T, bias=True) + len(b) * np.cov(b.T, bias=True)) / 800
        cov = (1 - s) * cov + s * pooled
        d = a[:20] - x.mean(0)
        logs.append(np.log(len(x) / 800) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(got, 1 / (1 + np.exp(logs[0] - logs[1])))


def test_toxicity_held_out_and_located(labelled):
    docs, labels = labelled
    got = toxicity.score(docs, labels, locate=True)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows.values())
    assert accuracy(got, labels, "toxic") > 0.95
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    spans = [text[i][s["start"]:s["end"]] for i, r in rows.items() for s in r["spans"]]
    assert np.mean(["vilestem" in s for s in spans]) > 0.9


def test_toxicity_without_labels(spark, labelled):
    got = toxicity.score(labelled[0], spark.createDataFrame([], "doc_id long, toxic int"))
    assert got.where("predicted = 1 and doc_id < 10").count() == 0
    assert toxicity.score(labelled[0].limit(0), labelled[1]).count() == 0


TEXTS = ["", None, "a", "Hello world. How are you?  Fine!", " lead", "tail ", "x\n\ny \n z", "it's 12,5% – naïve café 漢字 🙂", "one two " * 3000, "a" * 5000, "two  spaces   three", "nb sp 　 wide", "<|endoftext|> plain"]


def packed(spark, size=1024, texts=TEXTS):
    df = spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)], "doc_id long, text string, start string").repartition(2)
    return packing.pack(df, tokenizer_file("byte_bpe_50k.json"), size).collect()


@pytest.mark.parametrize("size", [1024, 64])
def test_packing_covers_every_id_once(spark, size):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = packed(spark, size)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for k, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    pad = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        pad += 0 if at & (at - 1) == 0 else size - at
    assert pad <= 0.03 * sum(r["length"] for r in rows)


def test_packing_query_takes_added_tokens_as_the_tokenizer_does(spark, tmp_path):
    from tokenizers import Tokenizer

    from tessera.llm.queries import op7_packing
    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y z\n", "<|endoftext| > no", "é <|endoftext|>", " plain  words "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {}
    for r in op7_packing(spark, str(tmp_path)).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    for k, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert sum(r["length"] for r in rows[k]) == len(ids)
        for r in rows[k]:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())


def test_windows_are_optimal():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randint(1, 60)
        at = np.array(sorted({*(rng.randint(1, n) for _ in range(n)), n, *range(4, n, 4)}))
        cost = np.array([rng.choice([0.0, 2.0, 10.0]) for _ in at])
        best = {0: 0.0}
        for j, c in zip(at.tolist(), cost.tolist(), strict=True):
            best[j] = min(best[i] + 8 - (j - i) for i in best if j - 8 <= i < j) + c
        ends = packing.windows(at, cost, 8)
        value = dict(zip(at.tolist(), cost.tolist(), strict=True))
        assert ends[-1] == n and sum(8 - (b - a) + value[b] for a, b in zip([0, *ends], ends, strict=False)) == pytest.approx(best[n])


def test_packing_in_small_blocks_keeps_everything(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 3000)
    p = packing.Packer(packing.encoder(tokenizer_file("byte_bpe_50k.json")), 0, 128)
    rows = [r for k in range(200) for r in p.add(k, "Some words here. " * (k % 40))] + p.pack(True)
    total = sum(r[2] for r in rows)
    want = sum(len(p.tokens.encode("Some words here. " * (k % 40))) + 1 for k in range(200))
    assert total == want and len({(r[0], r[1]) for r in rows}) == len(rows)


def test_sentencepiece_equals_the_library(spark):
    model = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece_codec.codec(model).lib
    texts = [*TEXTS, "the" * 4000 + "zq" * 3000, "word another " * 2000, "漢字仮名" * 1500 + "\n" + "é" * 2000]
    df = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = sentencepiece_codec.encode(df, model, giant=4000, chunk=1000)
    rows = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert rows == {k: lib.encode(t or "") for k, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(got, model).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert sentencepiece_codec.digest(sentencepiece_codec.encode(df.limit(0), model), model).count() == 0


def test_sentencepiece_chunks_inside_units():
    c = sentencepiece_codec.codec(tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(10)
    for _ in range(60):
        text = "".join(rng.choice("abcdethingion é①\n ") for _ in range(rng.randint(1, 300)))
        text = text.replace(" ", "") if rng.random() < 0.5 else text
        marked = sentencepiece_codec.MARK + text.replace(" ", sentencepiece_codec.MARK)
        size = rng.choice([20, 40])
        parts, at = [], 0
        while at < len(marked):  # cuts anywhere that isn't a unit's edge
            end = min(len(marked), at + size)
            parts.append(("" if at == 0 else marked[max(0, at - 16):at], marked[at:end], "" if end == len(marked) else marked[end:end + 16], at == 0, end == len(marked)))
            at = end
        states = sentencepiece_codec.scan([set(c.transfer(*p)) for p in parts])
        assert [i for p, (s, t) in zip(parts, states, strict=True) for i in c.read_back(*p[:3], s, t)] == c.lib.encode(text)


def test_product_is_associative():
    a, b, c = ({((0, 0), (1, 0)), ((0, 0), (2, 1))}, {((1, 0), (3, 0)), ((2, 1), (0, 0))}, {((3, 0), (0, 0))})
    p = sentencepiece_codec.combine
    assert p(p(a, b), c) == p(a, p(b, c)) == sentencepiece_codec.product([a, b, c])


def test_giant_documents_of_many_groups_without_a_space(spark, monkeypatch):
    """Cuts inside units, products over several groups of chunks, repeated giants."""
    monkeypatch.setattr(sentencepiece_codec, "GROUP", 4)
    model = tokenizer_file("piece_bpe_32k.model")
    rng = random.Random(30)
    words = ["the", "tion", "zq", "é", "漢", "house", "①", "ing"]
    texts = ["".join(rng.choice(words) for _ in range(3000)), "a b " * 500 + "".join(rng.choice(words) for _ in range(2000)) + " c", "x" * 9000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    rows = {r["doc_id"]: r["ids"] for r in sentencepiece_codec.encode(df, model, giant=500, chunk=300).collect()}
    lib = sentencepiece_codec.codec(model).lib
    assert rows == {k: lib.encode(t) for k, t in enumerate([*texts, texts[0]])}


def test_licenses(spark):
    rows = [(1, "words\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "Released under the MIT License."), (3, "he has a driving license\nall rights and duties"),
            (4, None), (5, ""), (6, "SPDX-License-Identifier: BSD-3-Clause\nAll rights reserved."), (7, "the license of the road " * 20_000)]
    df = spark.createDataFrame([(*r, ["x"]) for r in rows], "doc_id long, text string, families array<string>")
    got = {r["doc_id"]: r["families"] for r in license_scan.scan(df).collect()}
    assert got == {1: ["apache-2.0"], 2: ["mit"], 3: [], 4: [], 5: [], 6: ["bsd", "proprietary"], 7: []}
    assert license_scan.scan(df.limit(0)).count() == 0


def test_hint_words_miss_nothing():
    """What a paragraph without hint words can share with a template stays below the confirming share."""
    hint = re.compile(license_scan.hint_pattern())
    for phrases in license_scan.TEMPLATES.values():
        for p in phrases:
            grams = license_scan._grams(p)
            assert sum(not hint.search(g) for g in grams) < license_scan.CONFIRM * len(grams)


def plain_operands(line):
    """Names without version in expressions on a line, by splitting at blanks."""
    names = {i for ids in license_scan.IDENTIFIERS.values() for i in ids}

    def bare(word):
        word = word.strip("()")
        fits = [n for n in names if word.startswith(n) and re.fullmatch(r"(-v?\d+(\.\d+)*)?(-only|-or-later|-Universal)?\+?", word[len(n):])]
        return max(fits, key=len, default=None)

    words, found = line.split(), []
    for k, w in enumerate(words):
        tag = w.lower().rstrip(":") == "spdx-license-identifier"
        if tag or bare(w):
            at = k + 1 if tag else k
            run = words[at:at + 1]
            while at + 2 < len(words) and words[at + 1] in ("OR", "AND", "WITH"):
                run.append(words[at + 2])
                at += 2
            if tag or sum(bare(x) is not None for x in run) > 1:
                found += [bare(x) for x in run if bare(x)]
    return list(dict.fromkeys(found))


def plain_licences(text):
    """The scan in plain code: units, probabilities and overlaps from the model's numbers."""
    weights, bias, temperature = license_scan.model()
    hint = re.compile(license_scan.hint_pattern())
    lines = (text or "").split("\n")
    hits = [k for k, x in enumerate(lines) if hint.search(x.lower()) or plain_operands(x)]
    spans, k = [], 0
    while k < len(hits):
        j = k
        while j + 1 < len(hits) and hits[j + 1] - hits[j] <= license_scan.GAP + 1 and all(x.strip(" ") for x in lines[hits[j] + 1:hits[j + 1]]):
            j += 1
        spans.append((hits[k], hits[j]))
        k = j + 1
    units = [(a, b, " ".join(lines[a:b + 1])) for a, b in [(h, h) for h in hits] + [s for s in spans if s[1] > s[0]]]
    units += [(h, h, "SPDX-License-Identifier: " + name) for h in hits for name in plain_operands(lines[h])]
    best = {}
    for a, b, unit in units:
        grams = license_scan._grams(unit)
        known = sum(any(weights[c].get(g) for c in weights) for g in grams)
        z = {c: (sum(weights[c].get(g, 0.0) for g in grams) / max(1, known) ** 0.5 + bias[c]) / temperature for c in bias}
        total = sum(math.exp(v) for v in z.values())
        for c, phrases in license_scan.TEMPLATES.items():
            overlap = 0.0
            for p in [*phrases, *("SPDX-License-Identifier: " + i for i in license_scan.IDENTIFIERS.get(c, ()))]:
                template = license_scan._grams(p)
                if len(template) > 3 or template <= grams:
                    overlap = max(overlap, len(grams & template) / len(template))
            if overlap >= license_scan.CONFIRM and (z[c] == max(z.values()) if a == b else z[c] > z["unknown"]):
                best[a, b, c] = max(best.get((a, b, c), (0.0, 0.0)), (math.exp(z[c]) / total, overlap))
    found = [(*k, *v) for k, v in best.items()]
    return sorted(x for x in found if x[0] == x[1] or not any(y[0] == y[1] and y[2] == x[2] and x[0] <= y[0] <= x[1] for y in found))


def wrapped(text, width, mark):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_licenses_equal_a_plain_scan_and_wrapped_headers_are_found(spark):
    rng = random.Random(21)
    prose = ["the ferry left the town under a pale moon", "", "a general report on the source of the river", "no words of that kind here", "all rights and duties of the citizens"]
    texts, want = [], []
    for family in ("mit", "apache-2.0", "gpl", "bsd", "isc", "mpl-2.0", "unlicense"):
        for mark, width in (("", 60), ("# ", 70), (" * ", 66), ("// ", 45)):
            longest = max(license_scan.TEMPLATES[family], key=len)
            texts.append("\n".join(["words before", "", wrapped(longest, width, mark), "", "words after"]))
            want.append(family)
    expressions = ["MIT OR Apache-2.0", "# SPDX-License-Identifier: (MIT OR GPL-2.0-or-later) AND BSL-1.0", "SPDX-License-Identifier: EPL-2.0 WITH no-exception-1.0", "either MIT OR neither", "under ISC AND Zlib here",
                   "SPDX-License-Identifier: CC-BY-NC-SA-4.0", "MIT-0 OR MITRE-2", "GPL-3.0+ OR LGPL-2.1-only OR MPL-2.0"]
    for _ in range(60):
        parts = [rng.choice([rng.choice(prose), rng.choice(expressions), wrapped(rng.choice(rng.choice(list(license_scan.TEMPLATES.values()))), rng.choice([30, 60, 500]), rng.choice(["", "# "]))]) for _ in range(rng.randint(1, 8))]
        texts.append("\n".join(parts))
    texts += [None, "", "\n\n", "license " * 3000, "\n".join(["license"] * 3000)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate([*texts, texts[0]])], "doc_id long, text string, p string, line int").union(
        spark.createDataFrame([(0, texts[0], "x", 1)], "doc_id long, text string, p string, line int"))
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        told, plain = got[k]["paragraphs"], plain_licences(t)
        assert [(x["line"], x["last_line"], x["family"]) for x in told] == [x[:3] for x in plain], t
        assert [y for x in told for y in (x["probability"], x["overlap"])] == pytest.approx([y for x in plain for y in x[3:]], abs=2e-6)
    assert [f in got[k]["families"] for k, f in enumerate(want)] == [True] * len(want)
    assert [got[k]["families"] for k in range(len(want))] == [[f] for f in want]


def test_calibration_is_on_other_material():
    given = {t for ts in license_scan.TEMPLATES.values() for t in ts} | set(license_scan.NOT_LICENCES)
    held = [(c, t) for c, ts in license_scan.HELD_OUT.items() for t in ts]
    assert not given & {t for _, t in held}
    _, _, temperature = license_scan.model()
    assert 0.15 < temperature < 8
    assert np.mean([plain_top(t) == c for c, t in held]) > 0.8 and all(plain_top(t) == "unknown" for c, t in held if c == "unknown")


def plain_top(text):
    weights, bias, _ = license_scan.model()
    grams = license_scan._grams(text)
    known = sum(any(weights[c].get(g) for c in weights) for g in grams)
    return max(bias, key=lambda c: sum(weights[c].get(g, 0.0) for g in grams) / max(1, known) ** 0.5 + bias[c])


def test_titles_identifiers_and_expressions(spark):
    want = {"The MIT License (MIT)": ["mit"], "Apache License\nVersion 2.0, January 2004": ["apache-2.0"], "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": ["gpl"],
            "SPDX-License-Identifier: GPL-2.0-only": ["gpl"], "BSD 2-Clause License": ["bsd"], "zlib License": ["zlib"], "Eclipse Public License - v 2.0": ["epl"], "Boost Software License - Version 1.0": ["boost"],
            "Business Source License 1.1": ["busl"], "MIT OR Apache-2.0": ["apache-2.0", "mit"], "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSL-1.0": ["apache-2.0", "boost", "mit"],
            "license: MIT OR GPL-3.0+": ["gpl", "mit"], "He studied at MIT OR at Yale": [], "she has a driving license from MIT": [], "SPDX-License-Identifier: NOASSERTION": []}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(want)], "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in license_scan.scan(df).collect()}
    assert [got[k] for k in range(len(want))] == list(want.values())
    assert len(license_scan.TEMPLATES) >= 25 and set(license_scan.IDENTIFIERS) <= set(license_scan.TEMPLATES)


def test_every_identifier_is_its_own_family(spark):
    rows = [(c, f"SPDX-License-Identifier: {i}-2.0") for c, ids in license_scan.IDENTIFIERS.items() for i in ids]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in license_scan.scan(df).collect()}
    assert [got[k] for k in range(len(rows))] == [[c] for c, _ in rows]


def test_every_template_is_its_own_family(spark):
    rows = [(f"{c}{k}", c, p) for c, ps in license_scan.TEMPLATES.items() for k, p in enumerate(ps)]
    df = spark.createDataFrame([(k, "intro words\n" + p + "\nclosing words") for k, (_, _, p) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in license_scan.scan(df).collect()}
    assert [got[k] for k in range(len(rows))] == [[c] for _, c, _ in rows]


PAGE = """<!DOCTYPE html><html><head><title>T {0}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><p>Site</p></header><nav><ul><li><a href="/a">A{0}</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- x --><div class="ad">Buy {0}</div><article><h1>Head &amp; tail {0}</h1><p><b>Sub {0}<br><p>First   para\n{0}.</p><p>Second<br>line.</p>{1}</article>
<aside class="sidebar">Side</aside><section id="comments"><p>Nice {0}</p></section><form><label>Mail</label></form><footer>&copy; {0}</footer>{2}"""


def test_pages(spark):
    rows = [(k, f"https://h{k % 2}.example.com/{k}", PAGE.format(k, "<ul><li>x<li>y</ul>" if k % 3 == 0 else "", "</body></html>" if k % 2 else "")) for k in range(30)]
    rows += [(30, "https://new.example.com/", None), (31, None, ""), (32, "not a url", "plain &lt;text&gt; only"), (33, "https://h0.example.com/z", "<article><p>" + "<div>" * 3000 + "deep"),
             (34, "https://h0.example.com/q", "<p>broken <a href='x'>link<p>next &am &amp"), (35, "https://one.example.com/", "<article>" + "<p>long words</p>" * 5000 + "</article>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    for k in range(30):
        assert got[k]["text"] == f"Head & tail {k}\nSub {k}\nFirst para {k}.\nSecond line." + ("\nx\ny" if k % 3 == 0 else "")
    assert [got[k]["text"] for k in (30, 31, 32, 33)] == ["", "", "plain <text> only", "deep"]
    assert got[35]["text"].count("\n") == 4999
    assert html_extract.extract(df.limit(0)).count() == 0


def wrapper_of(pages):
    out = None
    for p in pages:
        out = html_extract.align(out, html_extract.expression(html_extract.parse(p)))
    return out


def rules_of(pages):
    return html_extract.Rules(wrapper_of(pages))


def test_wrapper_is_the_same_in_parts():
    pages = [PAGE.format(k, "<p>x</p>" * (k % 3), "") for k in range(6)]
    whole, halves = wrapper_of(pages), html_extract.align(wrapper_of(pages[:3]), wrapper_of(pages[3:]))
    assert html_extract.regex(whole) == html_extract.regex(halves)
    assert vars(html_extract.Rules(whole)) == vars(html_extract.Rules(halves))


def test_wrapper_infers_groups_options_and_slots():
    pages = [f"<body><h1>{k}</h1><p>Always</p>" + "<ul>" + f"<li>{k}</li>" * (k + 1) + "</ul>" + (f"<div>only {k}</div>" if k % 2 else "") + "<dl>" + "<dt>a<dd>b" * 3 + "</dl></body>" for k in range(4)]
    always = html_extract._hash("Always")
    made = html_extract.regex(wrapper_of(pages))
    assert made.startswith(f'<body><h1>#</> <p>"{always}"</> <ul>') and "(<div>#</>)?" in made and "(<dt>" in made and ")+</>" in made and "(<li>" in made


def test_neutral_class_names_are_judged_by_the_wrapper(spark):
    """Constant strings and lists of links go on a host whose class names say nothing, whatever the tags."""
    page = ('<html><body><div class="c1"><a href="/">Home</a> <a href="/a">About</a> <a href="/c">Contact</a></div><div><ul><li><a href="/{0}1">Story {0} one</a></li><li><a href="/{0}2">Tale {0} two</a></li>'
            '<li><a href="/{0}3">Text {0} three</a></li></ul></div><div class="c2"><h1>Title {0}</h1><p>Body of {0} with <a href="/x">a link</a> inside.</p><p>More {0}.</p></div><div class="c3">All pages say this.</div></body></html>')
    rows = [(k, "https://neutral.example.com/%d" % k, page.format(k)) for k in range(5)]
    rows += [(10 + k, "https://copies.example.com/%d" % k, f"<div>Bought {k}</div><p>One article that is the same on all of these pages, word for word.</p>") for k in range(4)]
    rows += [(20, "https://one.example.com/", "<div>Only page</div><p>of its host</p>")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(5)] == [f"Title {k}\nBody of {k} with a link inside.\nMore {k}." for k in range(5)]
    assert all("One article that is the same" in got[10 + k] for k in range(4))
    assert got[20] == "Only page\nof its host"


def test_class_words_inside_the_article_decide_nothing_alone(spark):
    page = ('<article><h1>T {0}</h1><div class="social-history tags">History {0}</div><p class="side-effects">Effects {0}</p><section class="notice">Notice {0}</section><h2>Summary</h2>'
            '<div class="ad">Buy {0}</div><div class="share"><a>Mail</a> <a>Post</a> <a>Print</a></div><div id="comments">Nice {0}</div><p>End {0}</p></article>')
    rows = [(k, f"https://m.example.com/{k}", page.format(k)) for k in range(4)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"T {k}\nHistory {k}\nEffects {k}\nNotice {k}\nSummary\nEnd {k}" for k in range(4)}


def test_depth_and_length_have_no_limit():
    deep = "<div>" * 1500 + "<nav>MENU</nav><p>text</p><footer>F</footer>" + "</div>" * 1500
    assert html_extract.read_page(html_extract.parse(deep), rules_of([deep])) == "text"
    rng = random.Random(3)
    long = "<body>" + "".join(rng.choice(["<p>a</p>", "<h2>b</h2>", "<ul><li>c</ul>", "<div>d</div>"]) for _ in range(30_000)) + "</body>"
    w = wrapper_of([long, long + "<p>e", "<p>f" + long])
    assert html_extract._size(w["parts"]) < html_extract.PARTS
    assert html_extract.read_page(html_extract.parse(long), html_extract.Rules(w)).count("\n") == 29_999


def test_wrappers_merge_in_a_tree(spark):
    rows = [(f"https://w.example.com/{k}", f"<div>{k}</div>" + "<p>x</p>" * (k % 4) + "<span>All</span>") for k in range(60)]
    df = spark.createDataFrame(rows, "url string, html string").repartition(30)
    got = html_extract.wrappers(df, fan=3).collect()
    assert len(got) == 1
    import json
    assert json.loads(got[0]["wrapper"])["pages"] == 60


def test_containers_around_the_article_stay(spark):
    body = "<p>First words of {0}.</p><p>And more of {0}.</p>"
    side = '<div class="sidebar">Side</div><div class="cookie-notice">We use cookies</div><div class="sidebar-left">Left</div>'
    kinds = ['<div class="content-sidebar-wrap"><main>' + body + "</main>" + side + "</div>", '<div class="site has-sidebar"><article>' + body + "</article>" + side + "</div>",
             '<div id="no-sidebar">' + body + "</div>" + side, '<div class="sidebar"><main>' + body + "</main></div>" + side, '<div class="sidebar-layout">' + body + side + "</div>",
             '<div id="header-page"><article>' + body + "</article></div>" + side,
             "<div>" + body + '</div><div class="comments-area"><article class="comment-body">Nice {0}</article></div>' + side, '<div class="related"><article>Read {0}</article></div><article>' + body + "</article>" + side]
    rows = [(10 * k + n, f"https://k{k}.example.com/{n}", "<html><body>" + html.format(10 * k + n) + "</body></html>") for k, html in enumerate(kinds) for n in range(3)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"First words of {i}.\nAnd more of {i}." for i, _, _ in rows}


def texts_of_host(pages: list[str]) -> list[str]:
    rules = rules_of(pages)
    return [html_extract.read_page(html_extract.parse(p), rules) for p in pages]


WORDS = "amber birch cedar delta ember fjord grove haven inlet juniper kelp lagoon".split()


def prose(k: int, salt: int) -> str:
    return " ".join(WORDS[(k * 7 + salt * 5 + j * (k + salt + 1)) % 12] + str(k) for j in range(9)) + "."


def test_template_inside_an_article_is_out():
    """Notices and menus that every page of a host has go, also inside the article and without telling names."""
    box = "<div class='xa'>Subscribe now to our letter.</div><ul><li><a href=/a>One</a><li><a href=/b>Two</a><li><a href=/c>Three</a><li><a href=/d>Four</a></ul>"
    for tag in ("article", "main", "div"):
        pages = [f"<body><{tag}><h1>Title {k}</h1><p>{prose(k, 1)}</p>{box}<p>{prose(k, 2)}</p></{tag}></body>" for k in range(8)]
        assert texts_of_host(pages) == [f"Title {k}\n{prose(k, 1)}\n{prose(k, 2)}" for k in range(8)]
    alone = html_extract.Rules(html_extract.align(None, html_extract.expression([html_extract.Node("", None)])))
    assert "Subscribe" in html_extract.read_page(html_extract.parse("<body><article>" + box + "<p>x y z</p></article>"), alone)  # the wrapper tells, not the page


def test_recurring_headings_paragraphs_and_references_stay():
    for tag in ("article", "div"):
        pages = [f"<body><p class=n>Site of all</p><{tag}><h1>T{k}</h1><h2>Abstract</h2><p>{prose(k, 1)}</p><p>We thank the editors.</p><h2>Method</h2><h3>Data</h3><p>{prose(k, 2)}</p>"
                 f"<h2>References</h2><p>{prose(k, 3)}</p><ol>{''.join(f'<li><a href=/{k}{j}>Work {k} of {j}</a>' for j in range(5))}</ol></{tag}><div><h3>More</h3><ul><li><a href=/x>X</a><li><a href=/y>Y</a><li><a href=/z>Z</a></ul></div></body>"
                 for k in range(8)]
        want = ["\n".join([f"T{k}", "Abstract", prose(k, 1), "We thank the editors.", "Method", "Data", prose(k, 2), "References", prose(k, 3), *(f"Work {k} of {j}" for j in range(5))]) for k in range(8)]
        assert texts_of_host(pages) == want


def test_headings_that_lead_to_no_text_of_the_page_are_out():
    pages = [f"<body><div><h2>Topic {k}</h2><p>{prose(k, 1)}</p><h2>Stay in touch</h2><p>Write to us.</p></div></body>" for k in range(6)]
    assert texts_of_host(pages) == [f"Topic {k}\n{prose(k, 1)}" for k in range(6)]


@pytest.mark.parametrize("deep", [20, 99, 100, 101, 120, 700])
def test_depth_does_not_matter(deep):
    pages = [f"<body><div><p>{prose(k, 1)}</p></div>{'<div>' * deep}<b>Notice of the house</b><p>{prose(k, 4)}</p>{'</div>' * deep}</body>" for k in range(5)]
    assert texts_of_host(pages) == [f"{prose(k, 1)}\n{prose(k, 4)}" for k in range(5)]


def test_digits_of_class_words_tell_slots_apart():
    pages = [f"<body><div class=c7><a href=/1>Home</a><a href=/2>News</a><a href=/3>Shop</a></div><div class=c9>All of us say so.</div><div id=post-{k} class='post-{k + 12345}'><p>{prose(k, 1)}</p></div></body>" for k in range(6)]
    assert texts_of_host(pages) == [prose(k, 1) for k in range(6)]
    assert html_extract.regex(wrapper_of(pages)).count("<div post-0>") == 1  # numbers of pages are one mark, so their slots meet


def test_teasers_of_other_pages_are_out():
    card = "<article><h3><a href=/n{0}>Next: story {0}</a></h3><p>Teaser of {0}.</p></article>"
    pages = [f"<body><article><h1>Story {k}</h1><p>{prose(k, 1)}</p></article>{card.format(k + 1)}</body>" for k in range(5)]
    assert texts_of_host(pages) == [f"Story {k}\n{prose(k, 1)}" for k in range(5)]
    listing = "<body>" + card.format(1) + card.format(2) + "</body>"
    assert html_extract.read_page(html_extract.parse(listing), rules_of([listing])).count("Teaser") == 2  # a page of teasers is theirs


def test_copies_of_one_page_and_odd_ids(spark):
    page = "<body><article><div class=body><p>The same page, many times.</p><p>It stays.</p></div></article></body>"
    other = "<body><article><div class=body><p>{0} is alone.</p></div></article></body>"
    rows = [(None if k % 3 == 0 else 5, "https://c.example.com/p", page if k < 8 else other.format(k)) for k in range(12)] + [(5, None, None), (None, None, "")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    want = [(i, u, "" if not h else "The same page, many times.\nIt stays." if k < 8 else f"{k} is alone.") for k, (i, u, h) in enumerate(rows)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    assert sorted(((r["page_id"], r["url"], r["text"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
