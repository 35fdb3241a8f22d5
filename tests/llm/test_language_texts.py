"""Language by compression: literal texts against plain compression of whole texts, and mixtures by volume."""

import random

import pytest
import zstandard

from clinprep.llm import language

SYLLABLES = {"aa": ["ka", "lo", "mi", "ten", "sur"], "bb": ["ich", "wer", "ung", "zen", "auf"], "cc": ["tion", "eau", "que", "roi", "ment"]}


def words(code, n, seed):
    rng = random.Random(f"{code}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[code]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def packers():
    return language.compressors({code: language.normalised(words(code, 4000, 0)) for code in SYLLABLES})


def by_force(text):
    """Size of all pieces of the whole text under each dictionary, by one compressor per piece."""
    body = language.normalised(text)
    if not body:
        return "und"
    sizes = []
    for code in SYLLABLES:
        content = zstandard.ZstdCompressionDict(language.normalised(words(code, 4000, 0)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        search = zstandard.ZstdCompressionParameters.from_level(
            3, strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=18, search_log=3, chain_log=17, hash_log=17,
            target_length=32, write_content_size=0, write_checksum=0, write_dict_id=0)
        total = 0
        for at in range(0, len(body), language.PIECE):
            fresh = zstandard.ZstdCompressor(compression_params=search, dict_data=content)
            total += len(fresh.compress(body[at:at + language.PIECE] + language.TAIL))
        sizes.append((total, code))
    return min(sizes)[1]


TEXTS = [words(code, n, seed) for code in SYLLABLES for n in (3, 20, 300, 3000) for seed in (1, 2)] + [
    words("aa", 200, 3) + words("bb", 900, 3), words("cc", 20, 4) * 40 + words("aa", 90, 4), "", "²", "½ ① 12", "KA²lo MITEN", "..."]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_against_plain_compression(packers, i):
    assert language.classify(language.normalised(TEXTS[i]), packers)[0] == by_force(TEXTS[i])


@pytest.mark.parametrize("most", SYLLABLES)
@pytest.mark.parametrize("least", SYLLABLES)
def test_mixtures_go_to_the_larger_part(packers, most, least):
    if most != least:
        for seed in range(5):
            recurring = (words(most, 60, seed)[:300] + " ") * 30
            assert language.classify(language.normalised(recurring + words(least, 400, seed)[:1500]), packers)[0] == most


@pytest.mark.parametrize("text", ["²", "½ ①", "Ⅷ²", "123 ४५", "", None, "_ - !"])
def test_texts_without_letters(packers, text):
    body = language.normalised(text)
    assert (language.classify(body, packers)[0] == "und") == (not any(map(str.isalpha, text or "")))


def test_every_part_of_a_text_counts(packers):
    text = words("aa", 50, 1)
    assert len(language.normalised((text + " ") * 100)) > 99 * len(text)
