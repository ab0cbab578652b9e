"""What commits say: the words of their messages, paths and changed lines."""

from __future__ import annotations

import json
import re
import unicodedata

#: Titles of automatic and merge commits, of the exports this reads.
AUTOMATIC = re.compile(
    r"(?:Merged? |merge$|Bump \S+ from |Release \d|Release v\d|chore\(deps\)|chore: regenerate|\[auto\]|\[bot\]|Build \d+ |Automatic update|Update copyright|Automatic merge|Auto-merge|build\(deps\))", re.I
)
#: Lines of a message that only refer to people, tickets or other commits.
TRAILER = re.compile(
    r"(?:[A-Z][\w-]*-by: |Change-Id|Cc: |cc |Ref: |Refs? |See #|Closes |Fixes #|fixes gh-|Issue|Bug: |Ticket|\(cherry picked|\(found while|Like the \S+(?: \S+)? ticket|# Conflicts|#\t|git-svn-id|This reverts commit|Reviewed|Link: )"
)
#: Files that hold translations or are made by tools.
SKIPPED = re.compile(r"(?:(?:^|/)(?:locales?|i18n|l10n|translations?|lang)/|\.(?:po|pot|xliff|arb|lock|sum)$|(?:^|/)(?:package-lock\.json|requirements\.txt|yarn\.lock|VERSION|versions\.lock|go\.sum)$)")

HEADER = re.compile(r"(?:Author|AuthorDate|Commit|CommitDate|Committer|Date|From|To|Message-Id|In-Reply-To|X-[\w-]+): |# (?:User|Date|Node ID|Parent|Branch) |MIME-Version|Content-T|Mon Sep 17")
START = re.compile(r"commit [0-9a-f]{7,40}\b|From [0-9a-f]{40} |# HG changeset patch|-{60,}$")
SVN = re.compile(r"r\d+ \| ")
DIFF = re.compile(r"diff --git (?:a/)?(.*?) (?:b/)?\S+$|diff -r \S+ (?:-r \S+ )?(.*)$|Index: (.*)$")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[^\W\d_]+")
WIDE = re.compile("[぀-ヿ㐀-鿿]+")


def content(text: str) -> list[str]:
    """The lines of a document that tell what its commits deal with. Left out: headers, automatic and merge commits'
    messages, trailers and tickets, unchanged lines, files of translations or made by tools."""
    out: list[str] = []
    if text.lstrip()[:1] == "{":
        for line in text.split("\n"):
            if line.lstrip()[:1] == "{":
                try:
                    c = json.loads(line, strict=False)
                    parts = (c.get("message"), c.get("patch"))
                except (ValueError, AttributeError):  # a broken line: what can be made out of it
                    message, _, patch = line.partition('"patch"')
                    parts = tuple(p.replace("\\n", "\n").replace("\\t", "\t").replace('\\"', '"') for p in (message.partition('"message": "')[2], patch))
                _commits("\n".join(["commit 0000000", "", *(str(p) for p in parts if p)]), out)
        return out
    _commits(text, out)
    return out


def _names(lines: list[str], k: int) -> bool:
    """Whether line k is one of the two that name a file, before a hunk."""
    k -= lines[k][0] == "+"
    return k >= 0 and lines[k].startswith("--- ") and "".join(s[:4] for s in lines[k + 1 : k + 2]) == "+++ " and "".join(s[:2] for s in lines[k + 2 : k + 3]) == "@@"


def _commits(text: str, out: list[str]) -> None:
    state, title, auto, skip, hunk = "message", True, False, False, False
    lines = [s for s in text.replace("\r", "\n").split("\n") if s]
    for k, line in enumerate(lines):
        first = line[0]
        if state == "file":
            if first in "+-":
                if not skip and not (line.startswith(("+++ ", "--- ")) and (not hunk or _names(lines, k))):
                    if line in ("-- ", "---"):
                        state = "tail"
                    else:
                        out.append(line[1:])
                    continue
                if START.match(line):
                    state, title, auto, skip = "message", True, False, False
                continue
            if first in " \t@\\":
                hunk = hunk or line.startswith("@@")
                continue
        if first in "cF#-" and START.match(line):
            state, title, auto, skip = "message", True, False, False
            continue
        if first in "dI" and (m := DIFF.match(line)):
            path = m[1] or m[2] or m[3] or ""
            state, skip, hunk = "file", bool(SKIPPED.search(path)), False
            if not skip:
                out.append(path)
            continue
        if state == "message":
            s = line.strip()
            if not s or HEADER.match(line) or SVN.match(line):
                continue
            if line.startswith("Merge: "):
                auto = True
                continue
            if s.startswith("Subject: "):
                s = re.sub(r"^Subject: (?:\[[^\]]*\] ?)?", "", s)
            if s == "---":
                state = "tail"
                continue
            if title:
                title, auto = False, auto or bool(AUTOMATIC.match(s))
            if not auto and not TRAILER.match(s):
                out.append(s)


def words(text: str | None) -> list[str]:
    """The different words of content(), sorted: names are cut at case and underscores, case, accents and a final s are
    dropped; of scripts without blanks, every two neighbouring signs."""
    if not text:
        return []
    s = "\n".join(content(text))
    if not s:
        return []
    found: set[str] = set()
    if not s.isascii():
        for run in WIDE.findall(s):
            found.update(run[i : i + 2] for i in range(len(run) - 1))
        s = WIDE.sub(" ", s)
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c) and c not in "​‌‍﻿­�")
    for w in set(WORD.findall(CAMEL.sub(" ", s).lower())):
        if 2 < len(w) < 40:
            found.add(w.rstrip("s") if len(w) > 3 else w)
    return sorted(found)
