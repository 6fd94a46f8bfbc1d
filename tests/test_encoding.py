"""Encodings by byte statistics: languages, marks, few characters, garbage, probes cut within a character, files."""

import pytest

from lakesignal.functions import encoding
from lakesignal.sources import tables

RUSSIAN = "Привет мир, это обычный текст на русском языке. МОСКВА"
TEXTS = [
    ("windows-1252", "cp1252", "Le café était déjà fermé, après la fête à Noël — «très» bien. Größe über Mädchen"),
    ("ISO-8859-1", "cp1252", "déjà été, une forêt"), ("windows-1251", "cp1251", RUSSIAN), ("KOI8-R", "koi8-r", RUSSIAN), ("ISO-8859-7", "iso8859-7", "Καλημέρα κόσμε αυτό είναι ένα κείμενο"),
    ("Shift_JIS", "shift_jis", "これはテストです。日本語の文章をカタカナで"), ("EUC-KR", "euc-kr", "안녕하세요 이것은 한국어 문장입니다"),
    ("GB18030", "gb18030", "这是一个中文句子，用来测试编码检测。"), ("UTF-8", "utf-8", "naïve café"), ("UTF-8", "utf-8", RUSSIAN),
    ("UTF-16LE", "utf-16-le", "hello there"), ("UTF-16BE", "utf-16-be", "hello there"), ("UTF-8", "utf-8-sig", "x"), ("UTF-8", "ascii", "plain, text\n1,2"),
]


@pytest.mark.parametrize(("name", "codec", "text"), TEXTS)
def test_languages(name, codec, text):
    assert encoding.encoding_of(text.encode(codec)) == name
    assert encoding.guess(("a,b\n" + text + "\n") .encode(codec) * 3)[0] == name or codec.endswith("sig")


def test_few_characters_are_less_sure():
    assert encoding.guess("un café".encode("cp1252")) == ("ISO-8859-1", encoding.FEW)
    assert encoding.guess(b"") == ("UTF-8", 1.0)
    assert encoding.encoding_of("naïve".encode()[:3]) == "UTF-8"  # cut within a character
    assert encoding.encoding_of(RUSSIAN.encode()[:-1]) == "UTF-8"


def test_garbage_is_read_byte_by_byte():
    assert encoding.encoding_of(bytes(range(128, 256)) * 3) == "ISO-8859-1"


@pytest.mark.parametrize("codec", ["cp1251", "utf-8", "cp1252"])
def test_delimited_files(spark, tmp_path, codec):
    name = RUSSIAN if codec == "cp1251" else "Émile déjà Noël über"
    (tmp_path / "f.csv").write_bytes(f'id,name\n1,"{name}"\n2,x\n'.encode(codec))
    rows = tables.read_delimited(spark, f"{tmp_path}/f.csv", "id int, name string").collect()
    assert [tuple(r) for r in rows] == [(1, name), (2, "x")]
