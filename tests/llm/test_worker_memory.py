"""What the encoder of training-data operators holds in a Python worker."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

from trailweave.llm import tokens

LIMIT_MB = 135

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

WORKER = """
import random, re
from pathlib import Path
import pyarrow as pa
from trailweave.llm import shared, textvec as tv, tokens
import public_tokenizers as P
held = lambda: int(re.search(r"Anonymous:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
rnd = random.Random(1)
word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(8))
batch = lambda: pa.array([" ".join(word() for _ in range(400)) for _ in range(100)])
shared.worker_tables("before")
for _ in range(3):
    for _, _, data, off in tv.slices(pa.array([t for _ in range(5) for t in batch().to_pylist()])):
        tv.Words(data, off).runs(13)
begun, most = held(), 0
encoder = tokens.cached(P.path("byte_bpe_50k.json"))
for _ in range(16):
    for _ in tokens.encoded(batch(), encoder):
        most = max(most, held())
print(most - begun)
"""


def test_chunks_that_come_again_stay_in_a_bounded_table(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CHUNKS", 500)
    encoder = tokens.load(P.path("byte_bpe_50k.json"))
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    learned, learn = [], encoder._learn

    def count():
        learned.append(len(encoder.new))
        learn()

    encoder._learn = count
    common = [f"word{i}," for i in range(100)]
    for n in range(20):
        texts = [" ".join(common), "<|endoftext|> " + " ".join(f"rare{n}x{i}" for i in range(200)), " ".join(common[::-1])]
        ids, counts = encoder.encode(texts)
        assert encoder.known <= 500 + 310
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
        assert counts.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert sum(learned) < 20 * 200 + 2 * 110  # a table that starts anew learns the common ones every other time


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_encoder_of_many_distinct_words_stays_small():
    made = subprocess.run([sys.executable, "-c", WORKER], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    assert float(re.findall(r"[\d.-]+", made.stdout)[-1]) < LIMIT_MB

