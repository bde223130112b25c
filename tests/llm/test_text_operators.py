"""Personal data, toxicity, BPE and token trees: brute force, round trips, held-out accuracy, odd cases."""

import hashlib
import math
import random
import re
import time

import pytest
import regex
from firmscope.llm import bpe, pii, tokentree, toxicity
from firmscope.llm.queries import tokenizer_path

SF01 = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_tables(tokenizer_path()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def brute_base(text):
    luhn = lambda d: sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = []
    for kind, pattern, fine in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if fine(m.group())]
    return ",".join(out)


def test_base_spans_against_plain_patterns_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op1_rows(docs).collect()}
    for d in docs.collect():
        base = brute_base(d["text"] or "")
        assert got[d["doc_id"]]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [got[d["doc_id"]][f"n_{k}"] for k in pii.KINDS] == [base.count(f"{k}:") for k in pii.KINDS]
        assert set(filter(None, base.split(","))) <= set(got[d["doc_id"]]["spans"].split(","))


def test_base_spans_on_random_strings():
    rnd = random.Random(2)
    for _ in range(20_000):
        s = "".join(rnd.choice(["a", "b.", "@", "@c", ".d", "-", "+", "1", "22", "255", "300", ".", " ", "(", "4111111111111111", "é", "%"]) for _ in range(rnd.randint(0, 14)))
        base = pii.base_spans(s)
        assert ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k]) == brute_base(s)


@pytest.mark.parametrize("text, hidden", [
    ("write john [at] mail (dot) example [dot] com now", ("email", "john [at] mail (dot) example [dot] com")),
    ("ask john dot smith at example dot co dot uk today", ("email", "john dot smith at example dot co dot uk")),
    ("jоhn@exаmple.com", ("email", "jоhn@exаmple.com")),
    ("４０４１８９４９７４６０８７９５!", ("card", "４０４１８９４９７４６０８７９５")),
    ("pay 4O4l894974608795.", ("card", "4O4l894974608795")),
    ("card four zero four one eight nine four nine seven four six zero eight seven nine five", ("card", "four zero four one eight nine four nine seven four six zero eight seven nine five")),
    ("call plus four nine one five one two three four five six seven eight ok", ("phone", "plus four nine one five one two three four five six seven eight")),
    ("at one nine two dot one six eight dot one dot one two", ("ip", "one nine two dot one six eight dot one dot one two")),
    ("a​nn@ex​ample.com", ("email", "a​nn@ex​ample.com")),
    ("host 192 dot 168 dot 10 dot 7 up", ("ip", "192 dot 168 dot 10 dot 7")),
    ("host 192[.]168(.)10{dot}7 up", ("ip", "192[.]168(.)10{dot}7")),
    ("ann&#64;mail.example&#46;com", ("email", "ann&#64;mail.example&#46;com")),
    ("ann%40example.com", ("email", "ann%40example.com")),
    ("mail ann AT example.com soon", ("email", "ann AT example.com")),
    ("ann_at_example_dot_com", ("email", "ann_at_example_dot_com")),
    ("see ann-at-example-dot-com", ("email", "ann-at-example-dot-com")),
    ("ann @ example . com", ("email", "ann @ example . com")),
    ("ann＠example．com", ("email", "ann＠example．com")),
    ("call + four four two zero seven nine four six zero nine five eight", ("phone", "+ four four two zero seven nine four six zero nine five eight")),
    ("+1 four one five 555 0134", ("phone", "+1 four one five 555 0134")),
])
def test_disguises_map_back_to_source_characters(text, hidden):
    base, found = pii.spans(text)
    kind, source = hidden
    assert [text[a:b] for a, b in found[kind]] == [source]
    assert set(base[kind]) <= set(found[kind])
    assert source not in pii.masked(text)


@pytest.mark.parametrize("text, base, whole", [
    ("j\u043ehn.smith@example.com", "hn.smith@example.com", "j\u043ehn.smith@example.com"),
    ("to john[dot]smith@example.com now", "smith@example.com", "john[dot]smith@example.com"),
    ("to john dot smith@example.com now", "smith@example.com", "john dot smith@example.com"),
    ("to john.smith@mail.example[dot]com now", "john.smith@mail.example", "john.smith@mail.example[dot]com"),
    ("to john.smith@mail.example dot com now", "john.smith@mail.example", "john.smith@mail.example dot com"),
    ("jo\u200bhn@example.com", "hn@example.com", "jo\u200bhn@example.com"),
    ("a@b.co, j\u043ehn@mail.example[dot]com, c@d.co", "hn@mail.example", "j\u043ehn@mail.example[dot]com"),
])
def test_identifiers_disguised_in_part_are_found_whole(text, base, whole):
    plain, found = pii.spans(text)
    assert base in [text[a:b] for a, b in plain["email"]]
    assert {text[a:b] for a, b in found["email"]} - {text[a:b] for a, b in plain["email"]} == {whole}
    assert set(plain["email"]) <= set(found["email"])
    assert pii.masked(text) == re.sub(r"[ac]@[bd]\.co(?!m)", "<EMAIL>", text).replace(whole, "<EMAIL>")


def test_partly_disguised_phone_and_lone_lookalikes():
    text = "call +44 20794 6095 8O1 ok"
    assert [text[a:b] for a, b in pii.spans(text)[1]["phone"]] == ["+44 20794 6095 8", "+44 20794 6095 8O1"]
    for text in ("call +44 20 7946 0958 I am home", "| +44 20 7946 0958 | 12 |"):  # a word, a column's end
        base, found = pii.spans(text)
        assert found["phone"] == base["phone"] and len(base["phone"]) == 1
    text = "ask a @ b.com or john@example.com . We answer"  # a full stop after a complete address
    assert [text[a:b] for a, b in pii.spans(text)[1]["email"]] == ["a @ b.com", "john@example.com"]
    text = "ask a @ b.com or john@example.co . uk"
    assert text[17:] in [text[a:b] for a, b in pii.spans(text)[1]["email"]]


@pytest.mark.parametrize("kind, source", [
    ("ip", "eight dot eight dot eight dot eight"), ("ip", "192 dot 168 dot zero dot one"), ("phone", "+44 two 079 four 609 five 58"),
    ("ip", "EIGHT dot 8 dot 8 dot Eight"), ("email", "john@example . com"), ("email", "ann\nAT\nexample.com"),
])
def test_disguises_do_not_depend_on_other_text(kind, source):
    for text in (f"at {source} ok", f"at {source} ok. one two, x @ y, (a) AT b"):
        assert [text[a:b] for a, b in pii.spans(text)[1][kind]] == [source]


def test_gate_of_spelled_rows_misses_none(monkeypatch):
    """The rows rewritten are those the rewriting finds without its gate."""
    rnd = random.Random(5)
    for _ in range(20_000):
        text = "".join(rnd.choice(["one", "Two", "oh", "dot", "point", "plus", "7", "12", "x", "+", ".", "  "]) + rnd.choice([" ", " ", ", ", "-", "   ", "    ", "", "\n"]) for _ in range(rnd.randint(0, 9)))
        with_gate, without = pii.Rewritten(text), pii.Rewritten(text)
        pii._spelled_digits(with_gate)
        with monkeypatch.context() as m:
            m.setattr(pii, "_SPELLED_PAIR", re.compile(""))
            pii._spelled_digits(without)
        assert with_gate.text == without.text, repr(text)


@pytest.mark.parametrize("text", ["he was at home. dot was there", "one or two of them", "at the bank.com dot", "it is 4 o'clock", "", "no. 5 at seven", "AT&T at noon . then", "we met at 5 . he left",
                                  "the point is 3 and a dot", "50%40 & more", "a state-of-the-art dot"])
def test_prose_is_left_alone(text):
    assert not any(pii.spans(text)[1].values()) and pii.masked(text) == text


def test_masking_keeps_rows_columns_and_nulls(spark):
    rows = [(1, "x a@b.co y", "en", "s", 10), (1, "x a@b.co y", "en", "s", 10), (None, None, None, None, None), (2, "", "en", "s", 0),
            (3, "10.0.0.1 a@b.co, " * 20_000, "en", "s", 5)]
    out = pii.mask_personal_data(spark.createDataFrame(rows, DOCS))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {(1, "x <EMAIL> y", 11), (None, None, None), (2, "", 0), (3, "<IP> <EMAIL>, " * 20_000, 14 * 20_000)}
    assert out.count() == 5


def test_toxicity_on_held_out_labels(spark):
    import zlib
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.op7_rows(docs, labels)
    got = {r["doc_id"]: r for r in out.collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(r["predicted"], truth[i]) for i, r in got.items() if r["held_out"] and i in truth]
    toxic = sum(y for _, y in held)
    assert sum(p and y for p, y in held) >= 0.8 * toxic  # some junk is labelled toxic without a toxic word
    assert sum(p and not y for p, y in held) <= 0.01 * (len(held) - toxic)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, r in list(got.items())[:500]:
        for span in filter(None, r["offending"].split(",")):
            a, b = map(int, span.split(":"))
            assert texts[i][a:b].strip() and "\n" not in texts[i][a:b]


def test_toxicity_scores_and_sentences_equal_a_plain_recount(spark):
    """The noisy-or of every document, and the sentences it points at, worked out again from the weights, letter by letter."""
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "..!?\n \n"), (-4, "a_b ÉÉ. İx! " * 30)], "doc_id long, text string"))
    model = toxicity.fit(toxicity.training_sample(docs, labels))
    weights = model["weights"]
    assert weights

    def plain(text):
        clean, spans, at = 1.0, [], 0
        for piece in "".join("\0" if c in ".!?\n" else c for c in text or "").split("\0"):
            words = set("".join(c if c.isalnum() else " " for c in piece.lower().replace("_", " ").replace("\u0307", " ")).split())
            if words:
                z = model["bias"]
                for w in words:
                    marked = "^" + w + "$"
                    z += sum(weights.get(f, 0.0) for f in {marked} | {marked[i:i + k] for k in (4, 5) for i in range(len(marked)) if i + k <= len(marked)})
                p = 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))
                clean *= 1 - p
                if p >= 0.5:
                    spans.append(f"{at}:{at + len(piece)}")
            at += len(piece) + 1
        return 1 - clean, ",".join(spans)

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pointed = 0
    for r in toxicity.score_documents(docs, labels).collect():
        score, spans = plain(texts[r["did"]])
        assert abs(r["score"] - score) < 1e-9 and r["offending"] == spans, r["did"]
        pointed += bool(spans)
    assert pointed


def test_toxicity_odd_rows(spark):
    rows = [(i, "you are an idiot. fine day" if i % 3 == 0 else "a fine day. quite so", "en", "s", 1) for i in range(120)]
    odd = [(None, "an idiot here", "en", "s", 1), (500, None, None, None, None), (501, "", "en", "s", 0), (501, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(None, 1, 1), (3, 1, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.op7_rows(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 500)
    assert [r["predicted"] for r in got if r["doc_id"] is None] == [1]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 80 + 3
    one_label = toxicity.op7_rows(docs, labels.where("toxic = 0")).collect()
    assert {r["score"] for r in one_label} == {0.0}
    none = spark.createDataFrame([], DOCS)
    assert toxicity.op7_rows(none, labels).count() == 0 and toxicity.op7_rows(docs, labels.limit(0)).count() == len(got)


def test_toxicity_learns_from_few_toxic_documents(spark):
    """Fewer than MIN_DOCS labelled toxic documents still make a model."""
    rows = [(i, "you are an idiot. fine day" if i % 12 == 0 else "a fine day. quite so", "en", "s", 1) for i in range(96)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 12 == 0)) for i in range(96)], "doc_id long, quality int, toxic int")
    got = toxicity.op7_rows(docs, labels).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 12 == 0) for r in got)


def test_automaton_equals_the_tokenizers_library(codec, library):
    rnd = random.Random(1)
    pieces = ["a", "aa", "the", "in", "ing", " ", "  ", "\n", "'ll", "'s", "==", "-", "é", "中", "<|endoftext|>", "<|endof", "0", "12", " ", "🙂", "x" * 40]
    cases = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    cases += ["a" * 5000, "ab" * 3000, "=" * 3000, "é" * 2000, "", " ", "�"]
    for s, e in zip(cases, library.encode_batch(cases, add_special_tokens=False)):
        ids = codec.encode(s)
        assert ids == e.ids, s
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == s


def test_automaton_accepts_one_path_for_a_toy_merge_list():
    """Against plain BPE over all short strings: lowest-ranked merge first, leftmost first."""
    from itertools import product
    labels = [b"a", b"b", b"aa", b"ab", b"aab", b"ba", b"abab"]
    merges = [(0, 0, 2), (0, 1, 3), (2, 1, 4), (1, 0, 5), (3, 3, 6)]
    auto = bpe.Automaton(labels, merges, {})

    def plain(word):
        seq = [labels.index(bytes([c])) for c in word]
        for u, v, w in merges:
            out, i = [], 0
            while i < len(seq):
                if seq[i:i + 2] == [u, v]:
                    out.append(w)
                    i += 2
                else:
                    out.append(seq[i])
                    i += 1
            seq = out
        return tuple(seq)

    for n in range(1, 11):
        for word in map(bytes, product(b"ab", repeat=n)):
            assert auto.encode_word(word) == plain(word)


def test_bpe_documents_and_odd_rows(spark, library):
    rows = [(1, "Hello there", "en", "s", 1), (1, "Hello there", "en", "s", 1), (None, None, "x", "s", 0), (2, "", "x", "s", 0), (3, "wort " * 30_000, "de", "s", 9)]
    docs = spark.createDataFrame(rows, DOCS)
    path = tokenizer_path()
    got = bpe.round_trip(docs, path).collect()
    want = {hashlib.sha256(",".join(map(str, library.encode(r[1] or "", add_special_tokens=False).ids)).encode()).hexdigest() for r in rows}
    assert {r["ids_sha256"] for r in got} == want and len(got) == 5
    assert {r["decoded_sha256"] for r in got} == {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows}
    back = bpe.decode_documents(bpe.encode_documents(docs, path), path).collect()
    assert sorted(r["text"] for r in back) == sorted(r[1] or "" for r in rows)
    assert bpe.round_trip(docs.limit(0), path).count() == 0


def test_token_trees_under_edits(codec):
    """After every edit the tree equals one built anew, and only a few pre-tokens were encoded."""
    rnd = random.Random(4)
    pieces = ["a", "the", " ", "  ", "\n\n", "'", "'l", "'ll", "s", "ve", "1", "..", "é", " x"]
    split = regex.compile(bpe.PATTERN)
    count = lambda w: len(codec.words[w])
    for _ in range(60):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.choice([0, 5, 400, 3000])))
        tree = tokentree.TokenTree(text, [(len(w), count(w)) for w in split.findall(text)])
        for _ in range(25):
            at, cut = rnd.randint(-2, len(text) + 2), rnd.choice([0, 0, 1, 3, 50, len(text) // 2 if rnd.random() < 0.1 else 2])
            put = "".join(rnd.choice(pieces) for _ in range(rnd.choice([0, 1, 3, 60])))
            a = max(0, min(at, len(text)))
            text = text[:a] + put + text[a + min(cut, len(text) - a):]
            tree.edit(at, cut, put, count)
            assert tree.text == text
            assert tree.items() == [(len(w), count(w)) for w in split.findall(text)]
            assert (tree.root.chars, tree.tokens) == (len(text), len(codec.encode_ordinary(text)))
            assert tree.tokens_before(len(text)) == tree.tokens


def test_edits_of_documents_and_odd_rows(spark, codec):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    edited = tokentree.derived_edits(docs)
    got = {r["doc_id"]: r for r in tokentree.op10_rows(docs, tokenizer_path()).collect()}
    for r in edited.collect():
        text = r["text"]
        before = len(codec.encode_ordinary(text))
        for e in r["edits"]:
            text = text[:e["at"]] + e["insert"] + text[e["at"] + e["remove"]:]
        g = got[r["doc_id"]]
        assert (g["n_before"], g["n_after"]) == (before, len(codec.encode_ordinary(text)))
        assert g["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert g["n_encoded"] <= 120
    odd = spark.createDataFrame([(None, None, None), (1, "", []), (2, "a b", [(None, 1, "x"), None]), (3, "a b", [(99, 5, None), (0, 1, "c")])],
                                f"doc_id long, text string, edits {tokentree.EDITS}")
    path = tokenizer_path()
    rows = sorted((r["did"], r["n_before"], r["n_after"]) for r in tokentree.edited_counts(odd, path).collect())
    assert [x[1:] for x in rows] == [(0, 0), (2, 2), (2, 2), (0, 0)]
    steps = tokentree.apply_edits(tokentree.build_trees(odd, path), path)
    assert sorted((r["did"], r["n_before"], r["n_after"]) for r in steps.collect()) == rows
    assert tokentree.op10_rows(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("piece", ["1", " ", "[", "a dot ", "a at ", "x@", ".", "|", "+1 ", "a@b dot ", "one ", "1.", "a . ", "_at_ ", "- "])
def test_personal_data_in_time_with_length(piece):
    n = 1_000_000 // len(piece) if piece in ("1", " ") else 300_000 // len(piece)
    for text in (piece * n, piece * n + "[at]", "john@" + piece * n + " . com"):
        t = time.time()
        pii.spans(text)
        assert time.time() - t < 2 + 8 * (len(text) / 1e6 > 0.9) * (piece not in ("1", " "))


@pytest.mark.parametrize("text, want", [
    ("a dot b dot c dot d dot e dot f at example dot com", (0, 50)), ("a1 dot b2 dot c3 dot d4 dot e5 dot f6@example.com", (0, 49)),
    ("mail x@mail dot eu dot example dot com now", (5, 38)), ("write to john.smith at example.com today", (9, 34)), ("mail: bob at example.org", (6, 24)),
    ("a_b at x.y.example.net.", (0, 22)), ("john [dot] [dot] smith [at] x.com", None)])
def test_addresses_of_any_number_of_labels(text, want):
    found = pii.spans(text)[1]["email"]
    assert (want in found) if want else found


@pytest.mark.parametrize("text", ["look at example.com", "meet me at home.Then go", "version 2.0 at example.com", "at example dot", "dot dot dot", "x at y"])
def test_prose_is_no_address(text):
    assert pii.spans(text)[1]["email"] == []
