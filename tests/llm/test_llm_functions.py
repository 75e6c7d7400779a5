"""Parts that run inside tasks, against brute force."""

import hashlib  # noqa: F401
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lociframe.llm import bagminhash, byte_bpe, html_text, licenses, pseudo_likelihood, quality, semi_crf

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.Vocabulary.load(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_bpe_equals_merging_and_round_trips(encoder, reference):
    rng = random.Random(3)
    letters = "aeé ütheingo '\n\t日本🎉0123#$  s\x1c²½"
    for size in [0, 1, 2, *(rng.randint(0, 60) for _ in range(400)), 3000]:
        text = "".join(rng.choice(letters) for _ in range(size))
        ids = encoder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()
        more = "".join(rng.choice(letters) for _ in range(rng.randint(0, 8)))
        assert encoder.append(text, ids, more) == encoder.encode(text + more)


def test_bpe_long_piece_and_edit(encoder, reference):
    text = "a" * 5000 + "theing" * 300
    assert encoder.encode(text) == reference.encode_ordinary(text)
    rng = random.Random(5)
    data = bytes(rng.choice(b"theinga ") for _ in range(2000))
    table = byte_bpe.Prefixes(encoder.vocabulary, data)
    assert table.edit(900, 905, b"xyzzy the") < 200
    assert table.last == byte_bpe.Prefixes(encoder.vocabulary, table.data).last


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(0)
    for most in (2, 6, 40):
        element = rng.integers(0, 2**62, 300).astype(np.uint64)
        a = rng.integers(0, most, 300)
        b = np.where(rng.random(300) < 0.6, a, rng.integers(0, most, 300))
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        equal = []
        for s in range(12):
            e = bagminhash._mix(element + np.uint64(s * 7919))
            r = bagminhash.signatures(doc, np.concatenate([e[a > 0], e[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
            equal.append((r[0] == r[1]).mean())
        assert abs(np.mean(equal) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.035


def test_signature_does_not_depend_on_company():
    e = np.array([1, 2, 3, 9], dtype=np.uint64)
    alone = bagminhash.signatures(np.zeros(3, int), e[:3], np.array([1, 2, 5]), 1)
    both = bagminhash.signatures(np.array([0, 1, 1, 1]), np.array([9, 1, 2, 3], dtype=np.uint64), np.array([4, 1, 2, 5]), 2)
    assert (alone[0] == both[1]).all()


def brute_repeated(words):
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    return len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)})


def test_quality_measures():
    rng = random.Random(1)
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        assert quality.repeated_words(words) == brute_repeated(words)
    assert quality.repeated_lines("a\na\n \n \nb\na") == 2
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 5.0])) == pytest.approx(1)
    assert quality.js_distance(np.array([2.0, 2]), np.array([1.0, 1])) == 0


def test_license_places_and_suppression():
    s = licenses.Scanner()
    n, n_base, first, last, base, labels, score, found = s.scan("Under the GNU Lesser General Public License v2.1. CC-BY 4.0; All rights reserved, all Rights  Reserved")
    assert (n, n_base, first, last, base) == (19, 4, 4, 16, "cc-by,gpl,reserved")
    assert "lgpl" in labels.split(",") and ("lgpl", 2, 9) in found and not any(x[0] == "gpl" for x in found) and 0 < score <= 1
    assert s.scan(None) == s.scan("") == (0, 0, None, None, "", "", 0.0, [])
    assert s.scan("Éccby xcc by cc byx")[1] == 0
    assert len(licenses.build_rules()) > 300
    assert "mit" in s.scan("Permission is hereby granted, free of charge, to any person obtaining a copy")[5]
    assert s.scan("cc by " * 20000)[1] == 20000


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    parts = ["a@b.c", "x.y@z-1.co.uk", "@", "1.2.3.4", "300.1.1.1", "+49 (30) 123-4567", "4111 1111 1111 1111", "4111111111111112", ".", " ", "+", "5", "a", "-", "@q.w", "é"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        plain = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        plain += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub(r"\D", "", m[0])
            if 16 <= len(digits) <= 19 and semi_crf.luhn(digits):
                plain.append(("card", *m.span()))
        plain += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
        assert semi_crf.base_spans(text) == plain


def test_best_path_equals_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = 5
        segments = [(i, j, None) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.5]
        scores, transition = rng.normal(size=(len(segments), semi_crf.K)), rng.normal(size=(semi_crf.K + 1,) * 2)

        def value(path):
            total, last, at = 0.0, 0, 0
            for c, k in path:
                i, j, _ = segments[c]
                for _ in range(i - at):
                    total, last = total + transition[last, 0], 0
                total, last, at = total + transition[last, k + 1] + scores[c, k], k + 1, j
            for _ in range(n - at):
                total, last = total + transition[last, 0], 0
            return total

        best, todo = -np.inf, [((), 0)]
        while todo:
            path, at = todo.pop()
            best = max(best, value(path))
            todo += [((*path, (c, k)), s[1]) for c, s in enumerate(segments) if s[0] >= at for k in range(semi_crf.K)]
        got = semi_crf.best_path(n, segments, scores, transition)
        index = {(i, j): c for c, (i, j, _) in enumerate(segments)}
        assert value([(index[i, j], k) for i, j, k in got]) == pytest.approx(best)


def test_field_on_held_out_examples():
    weights = semi_crf.train()
    found = right = true = 0
    for text, spans in semi_crf.examples(150, 99):
        got, want = set(semi_crf.field_spans(text, weights)), {(k, a, b) for a, b, k in spans}
        found, right, true = found + len(got), right + len(got & want), true + len(want)
    assert right / found > 0.75 and right / true > 0.65
    base, spans = semi_crf.all_spans("call +1 (826) 555-4081 or a@b.org", weights)
    assert [s[0] for s in base] == ["email", "phone"] and set(base) <= set(spans)
    assert semi_crf.all_spans(None, weights) == semi_crf.all_spans("", weights) == ([], [])
    assert semi_crf.all_spans("clean words at all times, 1999.", weights) == ([], [])


def test_main_text():
    page = ('<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav><a href=1>Menu</a></nav><div class="ad">Buy, buy, buy this thing now, really.</div>'
            '<article><h1>A &amp; B</h1><p><b>First  line,\n one.<br>Two<p>Second &lt;p&gt; here</p><script>var t="</p>";</script><ul class="menu"><li><a href=2>x</a></li></ul>'
            '<section id="comments"><p>I, a reader, say so, and more.</p></section></article><aside>Side</aside><form>Name</form><footer>&copy; 2020</footer>')
    assert html_text.extract(page) == "A & B\n\nFirst line, one. Two\n\nSecond <p> here"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<html></html>") == ""
    deep = "<div>" * 20000 + "<p>" + "words, and more of them. " * 5 + "</p>"
    assert html_text.extract(deep).startswith("words, and")
    assert html_text.extract("<p>a < b and <b>c</p><!-- never closed <p>no</p>") == "a < b and c"
    plain = "<body>" + "".join(f"<p>Paragraph {i}, with enough words to count as text, of course.</p>" for i in range(50)) + "</body>"
    assert html_text.extract(plain).count("\n\n") == 49


def test_network_learns():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"{a} {a}x {a}y" for a in rng.choice(["qa", "qb", "qc", "qd"], 40)) for _ in range(120)]
    slots = pseudo_likelihood.Slotter()
    data = [slots(t) for t in texts]
    counts = np.bincount(np.concatenate(data), minlength=pseudo_likelihood.SLOTS)
    output, _ = pseudo_likelihood.output_table(counts)
    w = pseudo_likelihood.initial_weights(counts, output)
    context, target = np.concatenate([pseudo_likelihood.windows(s) for s in data[:100]]), output[np.concatenate(data[:100])]
    for _ in range(40):
        for at in range(0, len(target), 1000):
            pseudo_likelihood.train_step(w, context[at:at + 1000], target[at:at + 1000], 0.4)

    def held_out(parts):
        c, t = np.concatenate([pseudo_likelihood.windows(s) for s in parts]), output[np.concatenate(parts)]
        return pseudo_likelihood.forward(w, c)[1][np.arange(len(t)), t].mean()

    assert held_out(data[100:]) > held_out([rng.permutation(s) for s in data[100:]]) + 0.3
    p = np.exp(pseudo_likelihood.forward(w, context[:50])[1])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert (pseudo_likelihood.flat(pseudo_likelihood.unflat(pseudo_likelihood.flat(w))) == pseudo_likelihood.flat(w)).all()


def test_hashed_tables():
    rng = random.Random(1)
    values = {rng.randrange(1 << 40): i for i in range(3000)}
    table = byte_bpe._hashed(values)
    keys = np.array([*values, *(k + 1 for k in itertools.islice(values, 500) if k + 1 not in values)])
    assert byte_bpe._look(table, keys).tolist() == [values.get(k, -1) for k in keys.tolist()]
