"""Token alignment against the untouched libraries and a comparison of all token pairs."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from helpers import awkward, crowded, frame
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lodestone.llm import alignment
from lodestone.llm.id_files import BYTE_LETTERS
from lodestone.llm.queries import QUERIES

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_file=PATHS[1])


def plainly(libraries, text):
    """Groups and links of a text, by all pairs of tokens; None without tokens."""
    if not text:
        return None
    first, second = libraries
    letters = {chr(letter): byte for byte, letter in BYTE_LETTERS.items()}
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
    bytes_b = [
        bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
        for i in b
    ]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None

    def ranges(tokens):
        at, out = 0, []
        for token in tokens:
            out.append((at, at + len(token)))
            at += len(token)
        return out

    a_at, b_at = ranges(bytes_a), ranges(bytes_b)
    groups, i, j = [], 0, 0
    for cut in sorted({e for _, e in a_at} & {e for _, e in b_at}):
        past_i = next(k for k in range(i, len(a)) if a_at[k][1] == cut) + 1
        past_j = next(k for k in range(j, len(b)) if b_at[k][1] == cut) + 1
        groups.append(",".join(map(str, a[i:past_i])) + "|" + ",".join(map(str, b[j:past_j])))
        i, j = past_i, past_j
    links, first_b = Counter(), 0
    for i, (s, e) in zip(a, a_at):
        while b_at[first_b][1] <= s:
            first_b += 1
        k = first_b
        while k < len(b) and b_at[k][0] < e:
            links[i, b[k]] += 1
            k += 1
    return len(a), len(b), len(groups), ";".join(groups), links


def expected(libraries, rows):
    """The rows of the query for (doc_id, text)."""
    found = [(doc_id, plainly(libraries, text)) for doc_id, text in rows]
    held = Counter(pair for _, x in found if x for pair in x[4])
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for doc_id, x in found:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = x[4]
        best = sum(n for p, n in links.items() if held[p] == most[p[0]])
        total = sum(n * held[p] for p, n in links.items())
        digest = hashlib.sha256(x[3].encode()).hexdigest()
        out.append((doc_id, *x[:3], sum(links.values()), best, total, digest))
    return sorted(out, key=str)


def weighed(docs, sent):
    from pyspark.sql import functions as F

    from lodestone.llm.tables import ready, stored

    ready(docs.sparkSession)
    found = stored(alignment.align(docs, *PATHS), "aligned")
    result = alignment.weigh(found, alignment.pair_counts(found), sent)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    names = "doc_id n_a n_b n_groups n_links n_best count_sum".split()
    return sorted(map(tuple, result.select(*names, digest).collect()), key=str)


STRANGE = [
    "a<|endoftext|>b", "<0x41> </s>", "x▁y", "\n\n  a\t b \r\n", "word　", "　 \x1c \x85x", "  ", "\n",
    "it's  we'll\n   indented\n\tcode();\r\n", "中文 text é😀", "\x00​", "12345 67", "x" * 50_000, "word " * 5_000,
]


@pytest.mark.parametrize("sent", [1_000_000, 40, 0])
def test_counts_of_awkward_rows(spark, libraries, sent):
    rows = [(r[0], r[1]) for r in awkward()] + [(100 + k, text) for k, text in enumerate(STRANGE)]
    docs = crowded(frame(spark, [(d, t, None, None) for d, t in rows]))
    assert weighed(docs, sent) == expected(libraries, rows)


def test_random_texts(libraries):
    rng = random.Random(5)
    letters = [*"ab cd e  \n\t\r.,'s$0123<>|éß中文▁　​\x1c\x85\x00😀 \xa0", "<|endoftext|>", "<0x41>", "   ", "'ll", " the"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    columns = [c.to_pylist() for c in alignment.Aligner(*PATHS).align(texts)]
    for k, text in enumerate(texts):
        wanted = plainly(libraries, text)
        found = tuple(c[k] for c in columns[:5])
        assert found == ((0, 0, 0, 0, "") if wanted is None else (*wanted[:3], sum(wanted[4].values()), wanted[3]))


def test_empty_table(spark):
    assert weighed(frame(spark, []), 10) == []


def test_worker_forgets_without_changing_results(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_STRETCHES", 3)
    own = alignment.Aligner(*PATHS)
    for text in ("one two three four", "two three five", "one six"):
        assert own.align([text])[4].to_pylist() == [plainly(libraries, text)[3]]


def test_groups_by_halves():
    assert alignment.shared_groups([], []) == ([], [])
    assert alignment.shared_groups([5], [1, 2, 5]) == ([1], [3])
    rng = random.Random(1)
    for _ in range(300):
        size = rng.randrange(1, 60)
        a = sorted({size, *(rng.randrange(1, size + 1) for _ in range(rng.randrange(20)))})
        b = sorted({size, *(rng.randrange(1, size + 1) for _ in range(rng.randrange(20)))})
        cuts = sorted(set(a) & set(b))
        assert alignment.shared_groups(a, b) == ([a.index(c) + 1 for c in cuts], [b.index(c) + 1 for c in cuts])


def test_query_over_the_table(spark, libraries):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    found = QUERIES["op11_token_alignment"](spark, SMALL)
    assert found.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted(map(tuple, found.collect()), key=str) == expected(libraries, rows)
