"""Token attribution and license matches against plain forms."""

import random
import re
import time
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tallyfold.llm import attribution, licenses

RANKS, TOK = P.path("byte_bpe_50k.tiktoken"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def spans(text):
    """Byte spans of tokens from the other library's ids."""
    sizes = [len(bytes(_byte(c) for c in TOK.id_to_token(i))) for i in TOK.encode(text, add_special_tokens=False).ids]
    ends = np.cumsum(sizes)
    return list(zip(ends - sizes, ends))


def _byte(c, table={}):  # noqa: B006
    if not table:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table.update({chr(b): b for b in plain})
        table.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)})
    return table[c]


def brute(text, bounds, rule):
    out = np.zeros(len(bounds) - 1)
    for s, e in spans(text):
        held = [(max(0, min(e, b) - max(s, a)), -k) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
        if rule == "first":
            out[next(k for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if a <= s < b)] += 1
        elif rule == "most":
            out[-max(held)[1]] += 1
        else:
            out += np.array([h for h, _ in held]) / (e - s)
    return out


@pytest.mark.parametrize("rule", attribution.RULES)
def test_lines_equal_brute_force(spark, docs, odd, rule):
    for df in (docs.orderBy("doc_id").limit(25), odd.where("doc_id <> 8 OR doc_id IS NULL")):
        got = {}
        for r in attribution.section_tokens(df, ranks_path=RANKS, pattern=P.PATTERN, rule=rule).collect():
            got.setdefault(r.doc_id, []).append(r)
        for r in df.collect():
            text = r.text or ""
            rows = sorted(got[r.doc_id], key=lambda x: x.section)
            if r.doc_id in (1, None):
                continue  # repeated ids
            bounds = attribution.line_bounds(text.encode())
            np.testing.assert_allclose([x.n_tokens for x in rows], brute(text, bounds.tolist(), rule) if text else [0])
            assert sum(x.n_tokens for x in rows) == pytest.approx(rows[0].doc_tokens) and rows[0].doc_tokens == len(spans(text))
    assert attribution.section_tokens(odd.where("false"), ranks_path=RANKS, pattern=P.PATTERN).count() == 0


def test_fields_and_crossing_tokens(spark):
    df = spark.createDataFrame([(1, "user", "hello there", "x")], "doc_id long, role string, text string, section string")
    got = {r.section: r for r in attribution.section_tokens(df, ranks_path=RANKS, pattern=P.PATTERN, fields=["role", "text"], joint=" ").collect()}
    assert got["role"].n_tokens + got["text"].n_tokens == got["role"].doc_tokens == len(TOK.encode("user hello there", add_special_tokens=False).ids)
    ends, bounds = np.array([4, 10, 12]), np.array([0, 5, 9, 12])
    assert attribution.attribute(ends, bounds, "first").tolist() == [2, 0, 1]
    assert attribution.attribute(ends, bounds, "most").tolist() == [1, 1, 1]
    assert attribution.attribute(ends, bounds, "share").tolist() == pytest.approx([1 + 1 / 6, 4 / 6, 1 / 6 + 1])
    with pytest.raises(ValueError):
        attribution.section_tokens(df, ranks_path=RANKS, pattern=P.PATTERN, rule="half")


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "Some words, 'tis the  end.\n\n" * 50 + "x" * 300 + " tail é 中文 " * 9
    want = [e for _, e in spans(text)]
    monkeypatch.setattr(attribution, "PIECE", 37)
    assert attribution.token_ends(text, RANKS, P.PATTERN).tolist() == want


def test_each_template_is_found_where_it_stands(spark):
    noise = "lorem ipsum dolor sit amet consectetur adipiscing elit "
    rows = [(k, noise * 3 + "é " + t + " " + noise) for k, t in enumerate(licenses.TEMPLATES.values())]
    got = licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for k, (name, t) in enumerate(licenses.TEMPLATES.items()):
        r = next(r for r in got if r.doc_id == k and r.license == name)
        assert r.coverage == 1.0 and r.matched_words == r.template_words == r.end_word - r.start_word
        found = rows[k][1].encode()[r.start_byte : r.end_byte].decode()
        assert found.lower().strip('."') in t.lower()
    assert licenses.license_matches(spark.createDataFrame([(1, noise * 50)], "doc_id long, text string")).count() == 0


def test_edited_copies_and_repeats():
    index = licenses.Index(licenses.TEMPLATES)
    words = licenses.TEMPLATES["MIT-text"].split()
    edited = words[:10] + ["really"] + words[10:20] + words[22:40] + ["other"] + words[41:]
    (m,) = [x for x in licenses.scan(("intro " * 7 + " ".join(edited) + " outro").encode(), index) if x[0] == "MIT-text"]
    assert m[2] == m[3] - 3 and (m[4], m[5]) == (7, 7 + m[3] - 2 + 1) and 0.9 < m[1] < 1
    twice = (licenses.TEMPLATES["MIT"] + ". Nothing here at all to see. ") * 2
    assert [x[4] for x in licenses.scan(twice.encode(), index) if x[0] == "MIT"] == [0, 11]
    assert not licenses.scan(b"released under the mit", licenses.Index({"x": "one two three four five six"}))
    assert [x[0] for x in licenses.scan(b"a public domain work", licenses.Index({"pd": "Public Domain", "none": ""}))] == ["pd"]


def whole_alignment(text, template):
    """(matched, first, last + 1) of the best local alignment, over all places."""
    best, score = (0, 0, 0, 0), {}
    for j, b in enumerate(template):
        for i, a in enumerate(text):
            d = score.get((i - 1, j - 1), (0, -1, 0))
            new = (d[0] + 1, i if d[0] <= 0 else d[1], 1 if d[0] <= 0 else d[2] + 1) if a == b else (d[0] - 1, d[1], d[2])
            for k in ((i, j - 1), (i - 1, j)):
                o = score.get(k, (0, -1, 0))
                new = (o[0] - 1, o[1], o[2]) if o[0] - 1 > new[0] else new
            score[i, j] = new = new if new[0] > 0 else (0, -1, 0)
            if new[0] > best[0]:
                best = (*new, i + 1)
    return best[2], best[1], best[3]


def test_equals_whole_alignment_of_each_template():
    index, rng = licenses.Index(licenses.TEMPLATES), random.Random(2)
    for name, text in licenses.TEMPLATES.items():
        words = re.findall("[a-z0-9]+", text.lower())
        for edits in ([("", 0)], [("x", 3)], [("", len(words) // 2)], [("x", len(words) // 3), ("y z", 2 * len(words) // 3)]):
            w = list(words)
            for new, k in edits if len(words) > 12 else edits[:1]:
                w[k : k + 1] = new.split() if new else [w[k]]
            noise = [f"n{rng.randrange(50)}" for _ in range(30)]
            w = noise[: rng.randrange(20)] + w + noise[20:]
            template = re.findall("[a-z0-9]+", text.lower())
            want = whole_alignment(w, template)
            got = [x for x in licenses.scan(" ".join(w).encode(), index) if x[0] == name]
            assert [(x[2], x[4], x[5]) for x in got] == ([want] if want[0] >= licenses.LEAST * len(template) else []), (name, edits)


def test_one_edited_word_never_hides_a_template():
    index = licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        words = re.findall("[A-Za-z0-9]+", text)
        for k in range(len(words)):
            edited = " ".join([*words[:k], "qqq", *words[k + 1 :]])
            assert len(words) < 5 or any(x[0] == name for x in licenses.scan(("a b " + edited + " c").encode(), index)), (name, k)


def test_many_repeats_take_time_in_proportion():
    index = licenses.Index(licenses.TEMPLATES)
    text = ((licenses.TEMPLATES["MIT"] + " and then. ") * 100_000).encode()
    start = time.perf_counter()
    assert sum(x[0] == "MIT" for x in licenses.scan(text, index)) == 100_000
    assert time.perf_counter() - start < 30


def test_license_odd_rows(odd):
    assert licenses.license_matches(odd).count() == 0 and licenses.license_matches(odd.where("false")).count() == 0


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 50):
        h = rng.integers(0, 9, n).astype(np.uint64)
        kept = set(licenses.winnow(h).tolist())
        assert all(kept & set(range(i, i + licenses.WINDOW)) for i in range(n - licenses.WINDOW + 1)) and (bool(kept) == (n > 0))
