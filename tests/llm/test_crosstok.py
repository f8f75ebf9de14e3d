"""The alignment of two tokenizers against a plain version of the contract."""

import hashlib
from collections import Counter

import pytest

from spanforge.llm import crosstok
from spanforge.llm.common import table
from spanforge.llm.tokenids import tokenizer_path
from tests.helpers import SF

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def plain(rows):
    """The result rows of (doc_id, text), by the libraries and loops over all pairs of a document."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    of = {c: x for x, c in crosstok._byte_symbols().items()}
    found, counts = [], Counter()
    for doc_id, text in rows:
        groups, links = [], []
        if text:
            whole = (" " + text).encode()
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [bytes(of[c] for c in a.id_to_token(i)) for i in ia]
            bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ib]
            if b"".join(ba) == whole == b"".join(bb):
                spans = []
                for parts in (ba, bb):
                    at, own = 0, []
                    for p in parts:
                        own.append((at, at + len(p)))
                        at += len(p)
                    spans.append(own)
                ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
                for low, high in zip([0, *ends], ends):
                    groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, own) if low < e <= high) for ids, own in ((ia, spans[0]), (ib, spans[1]))))
                j = 0
                for i, (s, e) in zip(ia, spans[0]):
                    while spans[1][j][1] <= s:
                        j += 1
                    k = j
                    while k < len(ib) and spans[1][k][0] < e:
                        links.append((i, ib[k]))
                        k += 1
                found.append((doc_id, len(ia), len(ib), groups, links))
                counts.update(links)
                continue
        found.append((doc_id, 0, 0, [], []))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [(d, na, nb, len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, x in found]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


ODD = [
    (1, "Hello  world, it's 12345 and \u4e2d\u6587 caf\u00e9 \U0001f600."), (2, None), (3, ""), (4, " "), (5, "a\u2581b"), (6, "<s> <|endoftext|> </s>"),
    (7, "x" * 5000), (8, "tab\there\n\nand  there "), (None, "no id"), (9, "same text"), (9, "same text"), (10, "same text"), (11, "\u0000nul"),
    (12, "word " * 9000), (13, "\u00e9" * 4000), (14, "a b\u00a0c\u3000d"),
]


def test_matches_plain_version(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    got = crosstok.align(docs, tokenizer_path(A), tokenizer_path(B)).select(*NAMES).collect()
    assert ordered(got) == ordered(plain([tuple(r) for r in docs.collect()]))


@pytest.mark.parametrize("known, block, links", [(2_000_000, 8192, 200_000), (3, 5, 40), (0, 1, 1)])
def test_odd_texts_small_blocks_and_rare_pairs(spark, known, block, links):
    few = ODD if block > 5 else [r for r in ODD if len(r[1] or "") < 100]
    docs = spark.createDataFrame(few, "doc_id long, text string").selectExpr("doc_id", "text", "1 as k", "'x' as links").repartition(3)
    got = crosstok.align(docs, tokenizer_path(A), tokenizer_path(B), known_pairs=known, block=block, links_in_row=links).select(*NAMES).collect()
    assert ordered(got) == ordered(plain(few))


def test_empty_table_and_bytes_that_are_no_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert crosstok.align(none, tokenizer_path(A), tokenizer_path(B)).collect() == []
    bad = spark.sql("select 1L as doc_id, cast(X'41FF42' as string) as text")
    assert ordered(crosstok.align(bad, tokenizer_path(A), tokenizer_path(B)).select(*NAMES).collect()) == [(1, 0, 0, 0, 0, 0, 0, "")]
