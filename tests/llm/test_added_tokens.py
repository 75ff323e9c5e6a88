import zlib

import numpy as np
from tokenizers import Tokenizer

from municipia.llm import token_files
from municipia.llm.queries import BYTE_MODEL

TEXTS = ["end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b c.", "one two", "x <|endoftext|>\n<|endoftext|>, y", "the last"]


def test_added_tokens_are_the_unmodified_librarys(spark, tmp_path):
    library = Tokenizer.from_file(BYTE_MODEL)
    ids = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert ids[0] == [437, 220, 50256, 1306]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files.WordTable(BYTE_MODEL).encode(TEXTS)] == ids
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), path, BYTE_MODEL)
    got = sorted(tuple(r) for r in token_files.read_token_files(spark, path, digest=True).collect())
    ends = np.cumsum([len(x) + 1 for x in ids]).tolist()
    assert got == [(k, ends[k] - len(x) - 1, len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for k, x in enumerate(ids)]
