"""Phrases that say what a message does, as plain lists, and the one rule that compiles them.

Fixed values: the lists name what people and agents write in these logs; results depend on them word by word. A phrase
matches as whole words, in any letter case; ``*`` at its end stands for any ending, ``...`` for up to 40 characters of
one sentence. A list of OPENING phrases matches at the beginning of a text only.
"""

from __future__ import annotations

import re

ACTS: dict[str, tuple[str, str]] = {  # act: (phrases anywhere, phrases at the beginning)
    "course_change": (
        "actually; turns out; scratch that; on second thought; i was wrong; my mistake; that is not it; that's not it; that's not right; that's not the cause; that's not the issue; that's not the problem; wrong assumption; wrong approach; wrong file; misread; "
        "instead of; rather than; different approach; switch to; switching to; fall back; fallback; falling back; won't work; didn't work; doesn't work; the real cause; the real issue; the real problem; not the cause; not the issue; not the problem", ""),
    "blocked": (
        "blocked; unable to; can't access; can't read; can't run; can't write; can't proceed; can't reach; can't verify; cannot access; cannot read; cannot run; cannot write; cannot proceed; cannot reach; cannot verify; "
        "not possible; not available; not accessible; giving up; no way to; permission denied; permission to use; access that i do not have", ""),
    "handback": (
        "need your; needs your; waiting on you; waiting for you; please approve; please confirm; please run; please review; please check; let me know; should i; do you want; want me to; your call; needs approval; need approval; over to you; when you're ready", ""),
    "verification": (
        "test pass*; tests pass*; test now pass*; tests now pass*; all green; all checks pass; verified; confirms it; confirms that; confirms the fix; confirmed it; confirmed that; confirmed the fix; typecheck passes; typecheck is clean; typecheck clean; build passes; build succeeded; build is green; lint passes; lint is clean", ""),
    "claim_done": (
        "is done; is merged; is deployed; is published; is shipped; is complete; are done; are merged; are deployed; are published; are shipped; are complete; has been done; has been merged; has been deployed; has been published; has been shipped; has been completed; have been merged; have been deployed; is fixed",
        "done; all set; finished; shipped; merged; deployed; published; complete"),
    "hypothesis": ("likely; probably; maybe; might be; could be; i suspect; suspects that; suspected the; my guess; hypothes*; i think the cause; i think the issue; i think this; i think it's; seems like; appears to be; may depend", ""),
    "evidence": (
        "found that; found the; found a; found an; the log shows; the logs show; the log says; the output shows; the output says; the error shows; the error says; the trace shows; the test shows; the test says; the diff shows; the query shows; the response shows; confirms the; according to; i see that; i see the; looking at ... shows; fails because; still red", ""),
    "decision": ("i'll go with; going with; decided; decide to; the fix is; i'm going to use; we should use; chose; choose to; choosing to; i leave; smallest step", ""),
    "plan": ("my plan; the plan is; next, i'll; next i'll", "now; next; then; first; finally; let me; i'll; i will; plan:; step:; steps:; here is the plan"),
}
#: Problems; a discovery is one of FINDERS with one of these in the same sentence, or a phrase of FOUND.
PROBLEMS = "bug; issue; problem; leak; leaking; regression; incident; race; vulnerabilit*; security hole; mismatch; contradiction; inconsisten*; drift; outage; corrupt*; broken"
FINDERS = "found; discovered; uncovered; spotted; noticed; caught"
FOUND = "root cause; turns out ... broken; turns out ... wrong; turns out ... missing; turns out ... never; turns out ... not; is broken; was broken; are broken; were broken; silently broken; production incident; production regression; production bug; prod incident; this is a bug; this is a regression; this is a leak; the cause lies elsewhere"
PLANS = "now let me; now i'll; now i will; next, let me; next let me; next, i'll; next i'll; then i'll; then i will; first, let me; first let me; first, i'll; finally, let me; finally, i'll; let me now; here is the plan"
LEAVES = "instead; fall back; fallback; falling back; switch to; switching to; different approach; didn't work; doesn't work; revert; reverting; reverted; rolling back; abandon; abandoning; work around; workaround; route around; a smaller change"
GIVES_UP = "blocked by; blocked on; blocked; unable to; can't access; can't read; can't run; can't write; can't proceed; can't reach; can't verify; cannot access; cannot read; cannot run; cannot write; cannot proceed; cannot reach; cannot verify; not possible; not available; not accessible; giving up; no way to; skipping this; skipping it; access that i do not have"
RULES = "from now on; always; never; every time; in future; in the future; going forward"
CORRECTIONS = ("leave ... alone", "no,; no.; no -; not like that; don't; stop; actually; instead; wrong; undo; revert")
#: Errors of named walls, by wall.
WALL_ERRORS = {
    "disk-full": "enospc; no space left", "heap": "heap out of memory; javascript heap", "port": "eaddrinuse; address already in use",
    "auth-expired": "oauth expired; session expired; oauth session expired; failed to authenticate; 401 unauthorized", "no-module": "cannot find module; module_not_found; err_module_not_found",
}
#: Texts of errors that are the agent's own slips with its tools.
SLIPS = "string to replace; has not been read; no site is open; file does not exist; not found in file; inputvalidationerror; must be unique; script error: syntaxerror; script error: referenceerror; script error: typeerror; apply_patch verification failed; invalid patch"


def _one(phrase: str) -> str:
    p = re.escape(phrase.strip()).replace(r"\ ", " ").replace("'", "['’]")
    return p.replace(r"\*", "[a-z]*").replace(r" \.\.\. ", r"[^.!?\n]{0,40}[^a-z]").replace(r" \.\.\.", r"[^.!?\n]{0,40}")


def words(phrases: str) -> str:
    """A pattern that Java and RE2 read alike: any of the phrases as whole words."""
    return rf"(?i)(^|[^a-z0-9])({'|'.join(_one(p) for p in phrases.split(';'))})($|[^a-z0-9])"


def opening(phrases: str) -> str:
    """As ``words``, at the beginning of a text."""
    return rf"(?i)^[ \t\n]*({'|'.join(_one(p) for p in phrases.split(';'))})($|[^a-z0-9])"


def either(anywhere: str, beginning: str) -> str:
    if not beginning:
        return words(anywhere)
    return f"{words(anywhere)}|{opening(beginning).removeprefix('(?i)')}"


def discovery() -> str:
    """A finder and a problem in one sentence, or a phrase that tells of a discovery."""
    group = lambda s: "(" + "|".join(_one(p) for p in s.split(";")) + ")"
    return rf"(?i)(^|[^a-z0-9]){group(FINDERS)}[^a-z.!?\n][^.!?\n]{{0,60}}{group(PROBLEMS)}($|[^a-z])|{words(FOUND).removeprefix('(?i)')}"
