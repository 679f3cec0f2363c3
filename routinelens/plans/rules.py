"""Rules as plain values: identity, automation form, sentence, and the numbers an explanation may use."""

from __future__ import annotations

import hashlib
import json
import re

#: What each service leaves its entity in.
REACHED = {"turn_on": "on", "turn_off": "off", "open_cover": "open", "close_cover": "closed", "lock": "locked", "unlock": "unlocked"}


def _filled(part: dict) -> dict:
    return {k: v for k, v in part.items() if v is not None and v != [] and v != ""}


def signature(miner: str, triggers: list[dict], conditions: list[dict], actions: list[dict]) -> str:
    """Sixteen hex digits of what a rule does; evidence does not enter. Triggers drop nulls, conditions all empty values."""
    some = [[{k: v for k, v in t.items() if v is not None} for t in triggers], [_filled(c) for c in conditions], actions]
    return hashlib.sha1(json.dumps([miner, *some], sort_keys=True, default=str).encode()).hexdigest()[:16]


def automation(rule_id: str, alias: str, triggers: list[dict], conditions: list[dict], actions: list[dict]) -> dict:
    """The rule in the form that a home controller reads."""
    key = {"kind": "trigger", "to_state": "to", "at": "at", "entity_id": "entity_id", "above": "above", "below": "below"}
    made = lambda part, name: {(name if k == "kind" else key.get(k, k)): v for k, v in _filled(part).items()}
    return {"id": rule_id, "alias": alias, "triggers": [made(t, "trigger") for t in triggers], "conditions": [made(c, "condition") for c in conditions], "actions": [{"action": a["service"], "target": {"entity_id": a["entity_id"]}, **({"data": a["data"]} if a.get("data") else {})} for a in actions]}


def target_state(service: str) -> str | None:
    return REACHED.get(service.rsplit(".", 1)[-1])


def _bounds(part: dict) -> str:
    return " and ".join(f"{word} {part[word]:g}" for word in ("above", "below") if part.get(word) is not None)


def _trigger(t: dict) -> str:
    if t["kind"] == "time":
        return f"at {t['at'][:5]}"
    if t["kind"] == "sun":
        return f"at {t['event']}" + (f" {t['offset']}" if t.get("offset") else "")
    if t["kind"] == "numeric_state":
        return f"{t['entity_id']} goes {_bounds(t)}"
    if t["kind"] == "state":
        becomes = f" becomes '{t['to_state']}'" if t.get("to_state") else " changes"
        return t["entity_id"] + becomes + (f" for {t['for_seconds']}s" if t.get("for_seconds") else "")
    return f"{t['kind']} {t.get('entity_id') or ''}".strip()


def _condition(c: dict) -> str:
    kind = c.get("kind") or ("time" if not c.get("entity_id") else "state" if c.get("state") else "numeric_state")
    if kind == "time":
        days = [f"on {', '.join(c['weekday'])}"] if c.get("weekday") else []
        return " and ".join([f"{k} {c[k]}" for k in ("after", "before") if c.get(k)] + days) or "any time"
    if kind == "sun":
        return f"sun {c.get('after') or c.get('before') or ''}".strip()
    return f"{c['entity_id']} is '{c['state']}'" if kind == "state" else f"{c['entity_id']} is {_bounds(c)}" if kind == "numeric_state" else kind


def _action(a: dict) -> str:
    more = ", ".join(f"{k}={v}" for k, v in sorted((a.get("data") or {}).items()))
    return f"{a['service'].split('.')[-1].replace('_', ' ')} {a.get('entity_id') or ''}".strip() + (f" ({more})" if more else "")


def sentence(triggers: list[dict], conditions: list[dict], actions: list[dict]) -> str:
    """The rule in words; without a trigger it always holds."""
    when = " or ".join(map(_trigger, triggers)) or "always"
    text = f"{'' if when.startswith('at ') else 'When '}{when}, {' and '.join(map(_action, actions))}".strip()
    only = " and ".join(map(_condition, conditions))
    return text[:1].upper() + text[1:] + (f" - but only if {only}" if only else "")


def evidence(known: dict) -> str:
    """One line of what speaks for a rule."""
    seen, of = known.get("occurrences"), known.get("opportunities")
    bits = [f"{seen} of {of}" if of else f"{seen} occurrences"] if seen else []
    for name, form in (("consistency", "consistency {:.0%}"), ("confidence", "confidence {:.0%}"), ("lift", "lift {:.2f}"), ("spread_minutes", "±{:.0f} min")):
        if known.get(name) is not None:
            bits.append(form.format(known[name]))
    return ", ".join(bits)


def touched(triggers: list[dict], actions: list[dict]) -> tuple[list[str], list[str]]:
    """The entities that start a rule and those that it acts on, each once and sorted."""
    names = lambda parts: sorted({p["entity_id"] for p in parts if p.get("entity_id")})
    return names(triggers), names(actions)


#: Numbers in words, which cannot be checked.
NUMBER_WORDS = frozenset(
    """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
    twenty thirty forty fifty sixty seventy eighty ninety hundred thousand half twice double dozen""".split()
)
#: Of which evidence fields one may be said to be "of" the other.
PAIRS = (("occurrences", "opportunities"), ("true_fires", "total_fires"), ("hits", "days"))


def invented_numbers(text: str, evidence: dict) -> list[str]:
    """What a text says in numbers that the evidence does not: a number that it does not have as such, rounded or as a percentage; a pair ("30 of 34")
    whose numbers it does not have as one; a number in words. Shares from 0 to 1 are not rounded to whole numbers."""
    allowed = set()
    for v in evidence.values():
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            share = 0 < abs(v) < 1
            allowed |= {f"{x:g}" for x in (v, round(v, 1), round(v, 2), *(() if share else (round(v),)), round(100 * v), round(100 * v, 1))}
    plain = re.sub(r"(?<=\d),(?=\d{3}\b)", "", text)
    same = lambda n: f"{float(n):g}"
    out = [n for n in re.findall(r"\d+(?:\.\d+)?", plain) if same(n) not in allowed]
    known = {(same(evidence[x]), same(evidence[y])) for x, y in PAIRS if evidence.get(x) is not None and evidence.get(y) is not None}
    for pair in re.findall(r"(\d+(?:\.\d+)?)\s+(?:out\s+)?of\s+(?:the\s+)?(\d+(?:\.\d+)?)", plain, re.IGNORECASE):
        if tuple(map(same, pair)) not in known:
            out += [n for n in pair if n not in out]
    return out + sorted(set(re.findall("[a-z]+", plain.lower())) & NUMBER_WORDS)
