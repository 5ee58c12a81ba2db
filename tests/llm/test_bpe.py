"""BPE encoding and decoding against the tokenizers library, on whole texts."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm.queries import op4_bpe

PARTS = [*"aeiou éÉßſΣςσİı字語🎉👍🏽\n\t\r\x0b\x0c  ́̈‍'\"-_.,!?0123456789", "the", " The", "ing", "tion", "don't", "é", "ﬁ", "Ⅳ", "<|endoftext|>", "<unk>", "</w>", "[UNK]", "<pad>", "~~", "http://x.y"]


def test_against_the_library(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " ", "\n", "x" * 5000, "word " * 4000, "ab\ncd", " lead and trail "]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 80))) for _ in range(3000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in op4_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
