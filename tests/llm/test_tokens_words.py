"""Alignment, packing and spelling variants against plain versions, and the encoders against their libraries."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeframe.llm import alignment, packing, spelling, tokens

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, row string, length string"
BYTES, PIECES, WORDS = (tokens.public_vocabulary(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = ["", "a", " a", "a ", "  a   b ", "\n\n a\t b", "<|endoftext|> x <|startoftext|>", "a\0b", "it's we'll I'VE", "ÀÉß µ ª º ²³ ¼ × ÷", "x\x1cy\x85z\xa0w", "\r\n a", "12345 67", "ﬁ Σας İ ▁x", "日本語 text", "é" * 50]


@pytest.fixture(scope="module")
def encoders():
    return tokens.ByteEncoder(BYTES, tokens.public_pattern()), tokens.PieceEncoder(PIECES), tokens.WordEncoder(WORDS)


def library_ids(encoder, text):
    return encoder.own.encode(text) if isinstance(encoder, tokens.PieceEncoder) else encoder.own.encode(text, add_special_tokens=False).ids


def rows_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "w", "r", "l") for i, t in enumerate(texts)], SCHEMA)


def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "no id here", "", "", ""), (None, "no id here", "", "", ""), (50, None, "", "", ""), (51, "twice again", "", "", ""), (51, "twice again", "", "", ""), (52, "word " * 30_000, "", "", "")], SCHEMA)


def test_encoders_give_the_ids_of_their_libraries(spark, encoders):
    r = random.Random(1)
    made = ["".join(chr(r.choice([r.randrange(256), r.randrange(32, 127), 32, r.randrange(97, 123)])) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    made += ["".join(r.choice([" ", "  ", "\n", "th", "ing", "é", "'s", "'", "ou", "ion", ".", "\xa0"]) for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    texts = [row.text or "" for row in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    for encoder in encoders:
        for text in ODD + made + texts:
            assert encoder.encode(text).tolist() == library_ids(encoder, text), text


def test_tokens_encode_to_themselves(encoders):
    """What lets ranks stand in for merges: every token comes from its own merges, in the order of ids."""
    for path, end in ((BYTES, ""), (WORDS, "</w>")):
        model = json.load(open(path, encoding="utf-8"))["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        assert made == sorted(made) and len(set(made)) == len(made)
        rank = {m: k for k, m in enumerate(merges)}
        for a, b in merges:
            token = a + b
            body = token[: -len(end)] if end and token.endswith(end) else token
            parts = list(body)
            if body != token:
                parts[-1] += end
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(rank)))
                assert (parts[best], parts[best + 1]) in rank, token
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
    pieces = encoders[1]
    for i, data in pieces.table.items():
        piece = data.decode("utf-8", "replace")
        if piece.startswith(" ") and len(piece) > 1 and not pieces.own.is_byte(i):
            assert pieces.own.encode(piece[1:]) == [i]


def plain_alignment(encoders, rows):
    a, b, _ = encoders
    found, counts = [], Counter()
    for doc_id, text in rows:
        row = None
        if text:
            p, q, data = library_ids(a, " " + text), library_ids(b, text), (" " + text).encode()
            ba, bb = [a.table.get(i, b"") for i in p], [b.table.get(i, b"") for i in q]
            if b"".join(ba) == data == b"".join(bb):
                ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
                groups, links, i, j = [], [], 0, 0
                for end in sorted({*ea} & {*eb}):
                    x, y = ea.index(end), eb.index(end)
                    groups.append(",".join(map(str, p[i : x + 1])) + "|" + ",".join(map(str, q[j : y + 1])))
                    links.append((p[x], q[y]))
                    i, j = x + 1, y + 1
                counts.update(links)
                row = len(p), len(q), groups, links
        found.append((doc_id, row))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(d, *((r[0], r[1], len(r[2]), len(r[3]), sum(counts[x] == most[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest()) if r else (0, 0, 0, 0, 0, 0, ""))) for d, r in found]


def test_alignment_against_plain(spark, encoders):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    for rows, df in ((docs, spark.read.parquet(f"{SF_DIR}/documents.parquet")), ([(r.doc_id, r.text) for r in odd(spark).collect()], odd(spark))):
        got = alignment.align(df)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_alignment(encoders, rows), key=repr)
    assert alignment.align(odd(spark).limit(0)).count() == 0


def test_groups_of_odd_arrays(spark):
    """Rows without tokens, without common ends and with tokens after the last one; no function of arrays is left to Spark, which takes twice the time of all else."""
    rows = [(1, [], [], [], []), (2, [5, 6, 7], [2, 4, 9], [8, 9], [4, 9]), (3, [5], [3], [8], [4]), (None, [5, 6, 70000], [1, 2, 5], [8, 9, 1], [2, 3, 4]), (2, [], [], [], []), (6, [1], [7], [0, 3], [5, 7])]
    out = alignment.aligned(spark.createDataFrame(rows, alignment.TOKENS).coalesce(1))
    pair = lambda a, b: a * alignment.PAIR + b
    want = [(1, 0, 0, 0, "", []), (2, 3, 2, 2, "5,6|8;7|9", [pair(6, 8), pair(7, 9)]), (3, 1, 1, 0, "", []), (None, 3, 3, 1, "5,6|8", [pair(6, 8)]), (2, 0, 0, 0, "", []), (6, 1, 2, 1, "1|0,3", [pair(1, 3)])]
    assert list(map(tuple, out.collect())) == want
    plan = alignment.aligned_documents(odd(spark))._jdf.queryExecution().toString()
    assert not any(f in plan for f in ("array_intersect", "lambdafunction", "zip_with"))


def test_links_are_few_kinds(encoders):
    """Linked tokens end alike, so their kinds are bounded by the vocabularies, not the corpus."""
    assert sum(map(len, encoders[0].table.values())) + sum(map(len, encoders[1].table.values())) < 700_000


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 200), min_size=1))
def test_plan_uses_every_piece_once(counts):
    patterns = packing.plan(counts, 60)
    used = Counter()
    for n, pattern in patterns:
        assert n > 0 and sum(length * copies for length, copies in pattern) <= 60
        used.update({length: n * copies for length, copies in pattern})
    assert used == counts
    assert sum(n for n, _ in patterns) >= -(-sum(k * n for k, n in counts.items()) // 60)


def test_exact_complements_are_found():
    assert packing.plan({70: 5, 30: 5}, 100) == [(5, [(70, 1), (30, 1)])]
    assert packing.plan({70: 2, 20: 2, 10: 2}, 100) == [(2, [(70, 1), (20, 1), (10, 1)])]
    assert packing.plan({70: 3, 16: 3, 9: 3, 5: 3}, 100) == [(3, [(70, 1), (16, 1), (9, 1), (5, 1)])]
    assert packing.plan({25: 9}, 100) == [(2, [(25, 4)]), (1, [(25, 1)])]
    assert packing.plan({}, 100) == []


def test_packing_against_the_library(spark, encoders):
    own = encoders[2].own
    for df in (spark.read.parquet(f"{SF_DIR}/documents.parquet"), odd(spark)):
        want = Counter()
        for r in df.collect():
            ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 1]
            for k in range(0, len(ids), 4096):
                piece = ids[k : k + 4096]
                want[(r.doc_id, k // 4096, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))] += 1
        got = packing.pack(df).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
        held = defaultdict(list)
        for r in got:
            held[r.sequence_id].append((r.offset, r.length))
        for pieces in held.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 4096
        total = sum(k[3] * n for k, n in want.items())
        assert len(held) <= 1.02 * total / 4096 + 1
    assert packing.pack(odd(spark).limit(0)).count() == 0


def test_equal_rows_without_ids_are_packed_each(spark):
    df = spark.createDataFrame([(None, "the same text")] * 500, "doc_id long, text string")
    got = packing.pack(df).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 500


def test_spelling_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_DIR}/documents.parquet'")
    cursor = con.execute(spelling.ORACLE)
    columns = [d[0] for d in cursor.description]
    df = spelling.spelling_variants(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    assert df.columns == columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got, want = sorted(map(tuple, df.collect()), key=repr), sorted(cursor.fetchall(), key=repr)
    assert got == want and any(r[1] for r in got)


def edited(a, b):
    return a != b and (any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b))) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)


def test_links_against_all_pairs(spark):
    r = random.Random(7)
    found = {"".join(r.choice("ab") for _ in range(r.randrange(7, 13))) for _ in range(700)} | {"a" * n for n in range(7, 20)} | {"éa" * 5, "éa" * 5 + "ÿ", "é" + "éa" * 5}
    rows = [(w, 2 + i) for i, w in enumerate(sorted(found))]
    n = dict(rows)
    want = {(a, b, n[b]) for a in found for b in found if abs(len(a) - len(b)) <= 1 and edited(a, b)}
    got = [tuple(x) for x in spelling.links(spark.createDataFrame(rows, "word string, n long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_forms_and_roots(spark):
    rows = [("variant", 1000), ("variants", 90), ("varients", 5), ("varientz", 2), ("nothing", 3), ("aspirin", 20), ("aspirix", 20), ("aspiriy", 2)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert (got["variants"].form, got["variants"].form_n, got["variants"].n_near) == ("variant", 1000, 2)
    assert (got["varients"].form, got["varients"].root) == ("variants", "variant")
    assert (got["varientz"].form, got["varientz"].root) == (None, "varientz")
    assert (got["nothing"].form, got["nothing"].root, got["nothing"].n_near, got["nothing"].form_n) == (None, "nothing", 0, None)
    assert (got["aspiriy"].form, got["aspiriy"].n_near) == ("aspirin", 2)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_odd_documents_have_words(spark):
    texts = ["Examples EXAMPLES examples", None, "", "123 !!", "Éxamples examplés"]
    got = {r.word: r.n for r in spelling.words(rows_of(spark, texts), least_count=1, damaged=10**12).collect()}
    assert got == {"examples": 3, "Éxamples": 1, "examplés": 1}
    assert spelling.spelling_variants(odd(spark)).count() == 0
    assert spelling.spelling_variants(odd(spark).limit(0)).count() == 0
    null = spark.createDataFrame([(None, "something"), (None, "something")], "doc_id long, text string")
    h = zlib.crc32(b":something")
    word = "something" if h % 31 else "something"[: h % 9] + "something"[h % 9 + 1 :]
    assert [tuple(r) for r in spelling.spelling_variants(null).collect()] == [(word, None, word, 2, 0, None)]
