"""Random keys without digits, and keys behind words."""

import random
import string

import pytest

from galewatch.llm import secrets
from galewatch.llm.queries import token_pattern, vocabulary

BEFORE = ["", "/home/user/projects/application/config/production/", "https/example/documents/public/archive/session="]


@pytest.fixture(scope="module")
def count():
    v = secrets.load_vocabulary(vocabulary("byte_bpe_50k.tiktoken"), token_pattern())
    return lambda s: len(v.encode_ordinary(s))


@pytest.mark.parametrize("before", BEFORE)
@pytest.mark.parametrize("letters", [string.ascii_letters, string.ascii_letters + string.digits])
@pytest.mark.parametrize("size", [20, 32, 40])
def test_random_keys_are_found(count, before, letters, size):
    rng = random.Random(size)
    found = 0
    for _ in range(200):
        text = f"see {before}{''.join(rng.choices(letters, k=size))} now"
        found += any(a <= 4 + len(before) and b == len(text) - 4 for a, _, b in secrets.dense_spans(text, [], count))
    assert found >= 0.97 * 200


def test_words_digests_and_identifiers_stay(count):
    digest = "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    for s in [
        "INTERNATIONALIZATION", "Donaudampfschifffahrtsgesellschaft", "getUserAccountInformation", "node_modules/kubectl/xterm/gzip/nginx",
        "a/b/c/d/e/f/g/h/i/j/k/l", "550e8400-e29b-41d4-a716-446655440000", digest, "kubernetes_deployment_name_v123456",
    ]:
        assert secrets.dense_spans(s, [], count) == []
