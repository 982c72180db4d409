"""Operators 11 to 13 against brute force: whole reports on hand-made rows, the search alone on random symbols."""
import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.llm import conversations, spelling, token_counts
from stepwise.llm.queries import vocabulary

CONVERSATIONS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                              T.StructField("text", T.StringType())])


# ----------------------------------------------------------------------------- 11

def cheapest(symbols):
    """(cost, edits) by a uniform-cost search over (cost, edits so far)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, edits, i, roles = heapq.heappop(heap)
        state = roles[-1:] or "-"
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(symbols) and state in "-a":
            return cost, edits
        wanted = "a" if state == "u" else "u"
        steps = [(3, "I", i, wanted)]
        if i < len(symbols):
            x = symbols[i]
            steps.append((4, "D", i + 1, ""))
            if x != "x":
                extra = 3 if x.isupper() else 0
                if x.lower() == wanted or (x.lower() == "s" and state == "-"):
                    steps.append((extra, "K", i + 1, x.lower()))
                steps.append((3 + extra, "R", i + 1, wanted))
        for more, edit, j, role in steps:
            heapq.heappush(heap, (cost + more, edits + edit, j, (roles + role)[-1:]))


def test_search_is_cheapest_and_least(monkeypatch):
    rng = random.Random(3)
    for block in (24, 2, 1):
        monkeypatch.setattr(conversations, "BLOCK", block)
        for _ in range(1500):
            symbols = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randrange(1, 12)))
            edits, _ = conversations.repair(symbols)
            assert conversations.audited(symbols, edits, [1] * len(symbols)) == cheapest(symbols)[::-1], symbols
    long = "".join(rng.choice("suaoxUA") for _ in range(600))
    assert conversations.audited(long, conversations.repair(long)[0], [1] * 600) == cheapest(long)[::-1]


def plain_report(rows):
    space = lambda v: " " if v is None else v
    by = {}
    for conv, turn, role, text in rows:
        kept = by.setdefault(conv, [])
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [r[0] for r in kept if r[0] is not None]
        seen, faults = set(), []
        for _, role, text in kept:
            core = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        first = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "o" for r in kept]
        symbols = "".join("x" if f in ("blank", "duplicate") else i.upper() if f else i for i, f in zip(first, faults, strict=True))
        cost, edits = cheapest(symbols)
        lines, roles, at = [], "", 0
        for edit in edits:
            wanted = "a" if roles[-1:] == "u" else "u"
            name = {"a": "assistant", "u": "user"}[wanted]
            if edit == "I":
                lines.append(f"{name}:")
                roles += wanted
                continue
            if edit != "D":
                lines.append(f"{kept[at][1] if edit == 'K' else name}:{kept[at][2]}")
                roles += kept[at][1][0] if edit == "K" else wanted
            at += 1
        assert re.fullmatch("(s?(ua)+)?", roles)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False)), cost, edits,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_conversations():
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(60)]),
             rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]),
             rng.choice([None, "", " \n", "Hi.", "Yes", "No!", "what? ", "a b c.", "é ", "x " * 3000])) for _ in range(300)]
    rows += [(10 + i, t, "user" if t % 2 == i % 2 else "assistant", f"t{t} {i}.") for i in range(60) for t in range(i % 9)]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(200)]
    rows += [(100, 7, "user", "again and again.")] * 150  # repeated rows
    rows += [(200 + i, i, "user", "gone") for i in range(40)]  # some conversations lose their only row
    return rows


@pytest.mark.parametrize("chunk_bits", [16, 3])  # 3: conversations are split over many tasks
def test_report_equals_brute_force(spark, chunk_bits):
    rows = odd_conversations()
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    for name in ("place", "chunk", "digest", "copies", "kind", "plan", "fault"):  # clashing names
        frame = frame.withColumn(name, F.lit("extra"))
    got = {r[0]: tuple(r)[1:] for r in conversations.repair_report(conversations.damage(frame), chunk_bits).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == plain_report(rows)
    assert any(v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for v in got.values())


def test_no_conversations(spark):
    assert conversations.repair_report(conversations.damage(spark.createDataFrame([], CONVERSATIONS))).count() == 0


def test_undamaged_conversation_is_kept(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hello!")]
    r = conversations.repair_report(conversations.undamaged(spark.createDataFrame(rows, CONVERSATIONS))).first()
    assert (r.audit, r.cost, r.illegal) == ("KKK", 0, 0)
    assert r.repaired_sha256 == hashlib.sha256(b"system:Be kind.\nuser:Hello?\nassistant:Hello!").hexdigest()


# ----------------------------------------------------------------------------- 12

def plain_variants(rows, damage=97):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % damage == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    near, form = {}, {}
    for w in words:
        others = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + k :] for i in range(len(w) + 1) for a in letters for k in (0, 1)}
        near[w] = [v for v in others - {w} if v in words]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words.get(form.get(w)))
    return out


def spelled_docs():
    rng = random.Random(7)
    stems = ["colour", "aaaaa", "aaaaaa", "aaaaaaa", "naïve", "naive", "straße", "pré×x", "banana", "ban÷ana", "abcde", "abcdef", "bcdef", "ÀÉÎÕÜ", "àéîõü", "l" * 500]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["", "", "", "s", "x"]) + rng.choice([" ", ", ", "1", "Ā"]) for _ in range(60)))
            for i in range(80)]
    near = lambda w: (lambda i: w[:i] + rng.choice(["", "q", "qu"]) + w[i + rng.choice([0, 1]) :])(rng.randrange(len(w)))
    rows += [(100 + i, " ".join([near(rng.choice(stems[:10]))] * rng.choice([1, 3, 6, 12]))) for i in range(300)]
    return rows + [(None, "colour colour colours"), (900, None), (901, ""), (902, "ten words " * 50_000), rows[0]]


@pytest.mark.parametrize("part_words", [50_000, 20])  # 20: many parts share nodes
def test_variants_equal_brute_force(spark, monkeypatch, part_words):
    monkeypatch.setattr(spelling, "PART_WORDS", part_words)
    rows = spelled_docs()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("word", "n", "place", "nodes", "part"):
        frame = frame.withColumn(name, F.lit("extra"))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame).collect()}
    want = plain_variants(rows)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 10 and any(v[0] not in (None, v[1]) for v in want.values())


def test_very_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 50)
    text = "Épée " * 100 + "x" * 200 + " end"
    total = sum(spelling.runs(text), collections.Counter())
    assert total == {"Épée".encode("latin-1"): 100, b"x" * 200: 1, b"end": 1}


def test_no_words(spark, no_docs):
    assert spelling.variants(no_docs).count() == 0


# ----------------------------------------------------------------------------- 13

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


PARTS = ["'re", "'ll", "'ve", "'s", "'", "re", "l", "ll", "the", " the", "hello", " ", "  ", "\n", "\t", " \n ", "1", "123", "é", "日本", "🎉",
         "<|endoftext|>", "<|", "endoftext", "|>", "!", "...", "=====", " ", "\u0085", "é", "Ünïcode", "\U00010940", "՘", "supercalifragilistic"]


def test_counts_of_every_prefix(library):
    counter, rng = token_counts.PrefixCounter(vocabulary("byte_bpe_50k.json")), random.Random(1)
    for _ in range(700):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        want = [library(text[:i]) for i in range(len(text) + 1)]
        assert counter.slice_counts(text).tolist() == want, text
        firsts, parts = zip(*counter.stream(text, 3), strict=True)
        assert [int(c) for p in parts for c in p] == want and firsts[0] == 0, text


def test_every_pair_of_scripts_is_cut_as_the_library_cuts():
    counter = token_counts.PrefixCounter(vocabulary("byte_bpe_50k.json"))
    for start in [0, 0x300, 0x500, 0x800, 0x2000, 0x3000, 0xA700, 0xFB00, 0x10900, 0x1D600, 0x1F300]:
        text = "".join(f"a{chr(c)}a1{chr(c)}1!{chr(c)}!\n" for c in range(start, start + 0x300) if not 0xD800 <= c < 0xE000)
        assert counter.pieces_of(text) == [text[a:b] for _, (a, b) in counter.pieces.split(text)]


def test_totals_and_stored_counts(spark, odd_docs, clashing, library):
    path = vocabulary("byte_bpe_50k.json")
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()] + [(700, "<|endoftext|> x" * 40), (701, " \n" * 300 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i is not None, i or 0, len(t.encode()), len(t), library(t)) for i, t in rows)
    got = token_counts.totals(docs, path, 100).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_chars, r.n_tokens) for r in got) == want
    texts = dict(rows)
    short = [r for r in got if r.n_chars < 500 and r.doc_id in (6, 9, 14, 15, 700, 701)]
    assert all(r.fit_chars == max(i for i in range(r.n_chars + 1) if library(texts[r.doc_id][:i]) <= 100) for r in short)
    for block in (64, token_counts.BLOCK):
        table = token_counts.prefix_table(docs, path, block).cache()
        asked = spark.createDataFrame([(700, 5), (700, 600), (701, 600), (701, 10**6), (15, -1), (15, None), (15, 64), (9999, 1), (4, 0)],
                                      "doc_id long, n_chars long")
        answers = {(r.doc_id, r.n_chars): r.n_tokens for r in token_counts.count_at(table, asked, block).collect()}
        assert answers == {(700, 5): library(texts[700][:5]), (700, 600): library(texts[700]), (701, 600): library(texts[701][:600]), (701, 10**6): None,
                           (15, -1): None, (15, None): None, (15, 64): library(texts[15][:64]), (9999, 1): None, (4, 0): 0}
        fits = {(r.doc_id, r.n_chars) for r in token_counts.longest_prefix(table, 100, block).collect()}
        assert fits == {(r.doc_id, r.fit_chars) for r in got}
    assert token_counts.totals(clashing, path, 5).count() == odd_docs.count()


def test_no_texts(spark, no_docs):
    path = vocabulary("byte_bpe_50k.json")
    assert token_counts.totals(no_docs, path, 5).count() == token_counts.prefix_table(no_docs, path).count() == 0
