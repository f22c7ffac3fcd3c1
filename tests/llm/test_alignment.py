"""Cross-tokenizer alignment against a plain version, token by token."""

import hashlib
from collections import Counter

import pytest
from helpers import counted, edge_rows, table

from epochwise.llm import alignment

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()

    def ends(parts):
        out, at = [], 0
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    links, out = [], []
    for _, text in rows:
        raw = (" " + text).encode() if text else b""
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        pa = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
        pb = [bytes([int(b.IdToPiece(i)[3:5], 16)]) if b.IsByte(i) else b.IdToPiece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(pa) != raw or b"".join(pb) != raw or not raw:
            links.append([])
            out.append((0, 0, 0, ""))
            continue
        ea, eb = ends(pa), ends(pb)
        both = [0, *sorted(set(ea) & set(eb))]
        groups = [([i for i, e in zip(ia, ea) if x < e <= y], [i for i, e in zip(ib, eb) if x < e <= y]) for x, y in zip(both, both[1:])]
        at_b = dict(zip(eb, ib))
        links.append([(i, at_b[e]) for i, e in zip(ia, ea) if e in at_b])
        out.append((len(ia), len(ib), len(groups), ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
    count = Counter(x for each in links for x in each)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    return [
        (i, na, nb, ng, len(own), sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own), hashlib.sha256(spelled.encode()).hexdigest() if na else "", spelled)
        for (i, _), own, (na, nb, ng, spelled) in zip(rows, links, out)
    ]


def more_rows():
    rows = edge_rows()[:-2] + [(None, None), (None, "same"), (None, "same"), (7, "same"), (7, "")]
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in rows]
    odd = ["<|endoftext|> <s> </s> <unk> <0x41>", "▁low line▁", "a b 　 c", "tab\tand\nlines \r\n  two  spaces   three ", "\x00nul", "\U0001f600 \U0001f468‍\U0001f469 smile", "é ﬁ ①", " ", "  lead", "x" * 700]
    return rows + [(100 + k, t) for k, t in enumerate(odd)]


@pytest.mark.parametrize(("block", "batch"), [(alignment.BLOCK_CHARS, alignment.BATCH_CHARS), (3000, 300), (1, 40)])
def test_alignment(spark, block, batch):
    rows = more_rows()
    got = alignment.align(table(spark, rows).repartition(3), A, B, block_chars=block, batch_chars=batch, with_groups=True)
    assert got.columns == COLUMNS
    assert counted(got.collect()) == counted(plain(rows))


def test_empty_table(spark):
    got = alignment.align(table(spark, []), A, B)
    assert got.columns == COLUMNS and got.count() == 0
    assert alignment.align(table(spark, [(1, None), (None, "")]), A, B).filter("n_a = 0 AND groups_sha256 = '' AND groups IS NULL").count() == 2


def test_long_texts_are_cut_where_nothing_changes():
    import sentencepiece  # noqa: F401

    both = alignment.Both(open(A, encoding="utf-8").read(), open(B, "rb").read())
    assert both.may_cut
    text = "word  two, three\n four five \t six \u00a0 \u00a0 seven" * 50 + " "
    parts = both.parts(text)
    assert len(parts) > 20 and " ".join(parts) == text
    for side in (0, 1):
        assert both.encode(parts)[side][0].tolist() == both.encode([text])[side][0].tolist()
