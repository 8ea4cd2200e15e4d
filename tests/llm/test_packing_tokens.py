"""Chunks of ASCII go through packing's tokenizer as arrays; a worker keeps neither them nor the memory of a task."""

import random
import subprocess
import sys

import numpy as np

from tributary.llm import common, packing
from tributary.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def test_plain_chunks_leave_no_cache_and_equal_the_library():
    rng = random.Random(3)
    letters = "abcXYZ019.,;-_#&é"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 12))) for _ in range(200)) for _ in range(20)]
    texts += ["", " ", "don't 'start 'Re", "a|b <|endoftext|> x<|endoftext|>y", "\x00a\x7f b\x1cc", "x" * 200 + " " + "1" * 100, " lead and trail \n", "ＡB ǅ é É é"]
    tokens = packing.ChunkTokens(PATH)
    lib = [e.ids for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(t, "<u4").tolist() for t in tokens.ids(texts)] == lib
    plain = [c for t in texts for c in t.split() if c.isascii() and not {"'", "|"} & {*c} and len(c) <= 64 and not any(o in c for o in packing.ODD)]
    assert len(plain) > 1000 and not {*plain} & {c for c in tokens.cache if not c.isalpha()}


USED = """
import gc, random, sys
from tributary.llm import packing
def used():
    return int(open('/proc/self/statm').read().split()[1]) * 4096 / 1e6
tokens = packing.ChunkTokens(sys.argv[1])
tokens.ids(['some words é'])
rng, before = random.Random(1), used()
texts = [' '.join(''.join(rng.choices('abcdefgé', k=9)) for _ in range(300_000)) for _ in range(1)]
tokens.ids(texts)
del texts
tokens.forget()
print(used() - before)
"""


def test_a_worker_gives_the_memory_of_its_task_back():
    out = subprocess.run([sys.executable, "-c", USED, PATH], capture_output=True, text=True, cwd=common.HOME, timeout=300)
    assert float(out.stdout.split()[-1]) < 60, out.stderr
