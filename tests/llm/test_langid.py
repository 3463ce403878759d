import pytest

pytest.importorskip("waymark.llm")
from waymark.llm import langid  # noqa: E402


@pytest.mark.parametrize("text", [
    "もう25回も来ていますが、夕方の光はいつ見ても飽きません。",
    "https://a.example/b2もう来ていますが、夕方の光はいつ見ても飽きません。",
    "#tokyo2夕方の光はいつ見ても飽きません。",
])
def test_number_in_a_script_without_spaces_erases_nothing(text):
    (start, end, letters), = langid.sentences(text)
    assert (start, end) == (0, len(text)) and "飽きません" in letters


def test_odd_tokens_links_and_tags_are_still_taken_out():
    text = "See you there at x9" + "abcde" * 5 + " https://a.example/b @someone #tag #東京 soon."
    assert [s for _, _, s in langid.sentences(text)] == ["see you there at soon"]


@pytest.mark.parametrize("text", [
    "यह जगह बहुत पुरानी है। यहाँ शाम को भीड़ होती है।", "ร้านนี้เปิดตั้งแต่เช้าถึงเย็น\nคนเยอะมากในวันหยุด", "هل هذا المكان مفتوح طوال الليل؟ لا أعرف أحدا هنا يعرف ذلك۔",
    "Πού είναι η παλιά αγορά της πόλης; Εδώ ήταν πάντα η πλατεία μας;",
])
def test_sentence_ends_of_other_scripts(text):
    found = langid.pieces(text)
    assert len(found) == 2 and all(whole for *_, whole in found) and found[-1][1] == len(text)


def test_fragments_are_no_sentences_but_are_kept():
    found = [(text.strip(), whole) for text, whole in [("Closed on Mondays."[s:e], w) for s, e, _, w in langid.pieces("Closed on Mondays.")]]
    assert found == [("Closed on Mondays.", False)]
    assert [w for *_, w in langid.pieces("Everything here was closed today. Ich bin schon 19 Mal hier gewesen")] == [True, False]
    assert langid.pieces("") == langid.pieces(" :) 12 https://a.example ") == []


def test_vowel_signs_stay_and_accents_go():
    assert langid.plain("हिन्दी Ça ÉTÉ Straße Øl é") == "हिन्दी ca ete strasse ol e"
