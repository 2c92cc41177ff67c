"""Invented prose in four languages."""

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of".split(), "de": "ein sch ung keit ber zu ver äu öß heit".split(), "fr": "eau tion que ré ère ou ai é ê çon".split(), "es": "ción mente ñas do ll rra ó ía que os".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))
