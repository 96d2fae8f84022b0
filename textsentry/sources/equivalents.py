"""Cheaper spellings of pack patterns and the words their matches must hold.

``SAFE_FORMS`` maps a pattern to one that finds exactly the same matches but
neither recurses per character (a deep Java regex recursion kills the executor)
nor rescans the same span from every start. ``GATES`` maps a pattern to words of
which every match holds at least one; texts without any of them are not matched.
``FILTERS`` maps a pattern to a cheap necessary condition for the texts that are left.
"""

from __future__ import annotations

from textsentry.sources import packs

# A local part starts where a search would first reach it: behind the previous
# match, or at a label that no valid chain of labels precedes.
_MAILBOX = (
    r"(?:(?<![a-z0-9])(?:(?<![a-z0-9][_|.])|(?<=\G[_|.]))|\G)"
    r"(?:[a-z0-9]++[_|.])*+[a-z0-9]++@(?=[a-z0-9])"
    r"(?:(?![-_|.]{2})[a-z0-9_|.-])*(?<=[a-z0-9])\."
)
_EMAIL = _MAILBOX + "[a-z]{2,5}"
# Components are separated by single backslashes and take all they can.
_WINDOWS_PATH = r"[^\w][a-zA-Z]:\\?+[^<>:/\\|?*]++(?:\\[^<>:/\\|?*]++)*+"

# The value-first branch can only start behind the previous match or at a quote:
# from any other character the one before it would have matched too.
_PASSWORD = (
    packs.PASSWORD_KEY_FIRST
    + r"""|(?:\G|(?=\\?['"]))(?:|\\)(?:|['"])[^'"]+?(?=[\\'":=!])(?:|\\)(?:|['"])(?:|\\)(?:|['"])"""
    + r"""(?::|={1,3}|!={1,2}) ?(?:|[.\w]{1,10})(?:password|passwd|pwd|pass)"""
)

SAFE_FORMS = {
    packs.EMAIL: _EMAIL,
    packs.WINDOWS_PATH: _WINDOWS_PATH,
    packs.PASSWORD: _PASSWORD,
}

# Tried once the words are found: a text without this has no match either.
_ELEVEN_DIGITS = r"(?-i)\d{11}"
FILTERS = {
    packs.ID_CARD: _ELEVEN_DIGITS,
    packs.MOBILE: _ELEVEN_DIGITS,
    packs.PASSWORD: (
        r"""p(?:assword|asswd|ass|wd)[.\w]{0,10}\\?['"]?(?:!?=|:|\)?\.val\()"""
        r"""|[:=] ?[.\w]{0,10}p(?:ass|wd)"""
    ),
}

GATES = {
    packs.EMAIL: ["@"],
    packs.INTERNAL_IP: ["127.0.0.1", "10.", "172.", "192.168."],
    packs.MAC: [":"],
    packs.WINDOWS_PATH: [":"],
    packs.JDBC: ["jdbc:"],
    packs.AUTH_HEADER: ["basic ", "bearer "],
    packs.CLOUD_KEY: ["access", "ltai"],
    packs.PASSWORD: ["pass", "pwd"],
    packs.API_KEY: ["api", "key", "token", "secret", "auth"],
    **{rule[2]: rule[-1] for rule in packs.EXTENDED_RULES if rule[-1]},
}
