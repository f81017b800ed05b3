"""Rule packs for the test tables, whose texts are made of syllables of four languages."""

from __future__ import annotations

from ..operators.rules import Rule

RULES = [
    Rule("termination", ("hation", "erthe", "ingth"), ("withthe",), ("en",), 2, 1),
    Rule("wages", ("onthe", "anthe", "ofthe", "inthe"), ("reedth", "edofth"), ("en", "fr"), 3, 2, required_any=("tion", "ment"), combinations=(("the", "and"), ("les", "des"))),
    Rule("overtime", ("ment", "eau", "aux"), ("quele", "leque"), ("fr",), 2, 2, blocked=("tionth",), blocked_max=2),
    Rule("secrecy", ("ción", "mente", "que"), ("dela", "enla"), ("es",), 2, 1, require_strong=True),
    Rule("training", ("ung", "keit", "sch"), ("derver", "unddie"), ("de",), 2, 1, groups={"a": ("ein", "ver"), "b": ("und", "der", "die")}),
]
