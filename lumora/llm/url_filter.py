"""3. URL filters: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

A term counts where no ASCII letter or digit touches it. One strict term blocks; soft terms block when
at least two different ones are found and their weights reach the limit.
"""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import DataFrame

#: The default vocabulary, by language. One strict term blocks.
STRICT_TERMS = """
porn porno pornos xxx hentai milf camgirls camgirl nudes escorts viagra cialis levitra casino casinos spam warez malware keygen phishing ransomware
pornografico pornografica putas casinos-online
pornographie pornographique putes
pornografie huren kasino
pornografia puttane bordello
putaria cassino
porevo kazino
"""
#: Soft terms with their weights, 1 (common in clean urls) to 3; two or more different ones block when their weights reach the limit.
SOFT_TERMS = """
adult 2 bet 2 bets 2 betting 3 cheap 1 escort 3 farm 1 free 1 jackpot 3 loan 2 loans 2 pills 2 poker 3 sex 3 win 1 sexy 3 nude 3 naked 3 erotic 3 dating 2 webcam 2 slots 2 roulette 3 blackjack 3 gambling 3 lottery 2 bonus 1 payday 2 crack 2 torrent 2 replica 2 pharmacy 2 hookup 3 fetish 3 topless 3
adultos 2 apuestas 3 gratis 1 prestamos 2 sexo 3 desnudas 3 loteria 2 farmacia 2
adulte 2 paris-sportifs 3 gratuit 1 pret 1 sexe 3 nue 3 loterie 2 pharmacie 2
erotik 3 wetten 2 kostenlos 1 kredit 2 nackt 3 lotto 2 apotheke 2
scommesse 3 prestiti 2 sesso 3 nuda 3 lotteria 2
apostas 3 emprestimos 2 nuas 3 sorteio 1
stavki 2 besplatno 1 seks 3 kredity 2
"""
SOFT_LIMIT = 4


def vocabulary(text: str) -> dict[str, int]:
    """Terms of a vocabulary text, each followed by its weight (0 where none follows)."""
    out: dict[str, int] = {}
    for word in text.split():
        if word.isdigit():
            out[next(reversed(out))] = int(word)
        else:
            out[word] = 0
    return out


STRICT, SOFT = tuple(vocabulary(STRICT_TERMS)), vocabulary(SOFT_TERMS)

_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_TOUCHES = frozenset(string.ascii_lowercase + string.digits)


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host (A to Z lower-cased), path, and all that follows the first ://; empty without it."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    after = rest[end:]
    stop = min((i for i in map(after.find, "?#") if i >= 0), default=len(after))
    return rest[:end].translate(_FOLD), after[:stop], rest


def automaton(strict=STRICT, soft=SOFT):
    import ahocorasick  # where it runs: on executors

    a = ahocorasick.Automaton()
    for t in strict:
        a.add_word(t, (t, 0))
    for t, w in soft.items():
        a.add_word(t, (t, w))
    a.make_automaton()
    return a


def vocabulary_blocks(a, text: str, limit: int = SOFT_LIMIT) -> bool:
    low, soft = text.translate(_FOLD), {}
    for end, (term, weight) in a.iter(low):
        before = end - len(term)
        if (before >= 0 and low[before] in _TOUCHES) or (end + 1 < len(low) and low[end + 1] in _TOUCHES):
            continue
        if not weight:
            return True
        soft[term] = weight
    return len(soft) > 1 and sum(soft.values()) >= limit


def rule_of(rules: dict[str, list[tuple[str, str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """The longest rule (rule, verdict) that fits the host or a domain above it."""
    best, at = None, 0
    while host and at >= 0:
        for start, rule, verdict in rules.get(host[at:], ()):
            if path.startswith(start) and (best is None or (len(rule), rule) > (len(best[0]), best[0])):
                best = rule, verdict
        at = host.find(".", at) + 1 or -1
    return best


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], strict=STRICT, soft=SOFT, limit: int = SOFT_LIMIT) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict (allow or block).

    rules: (rule like example.com/en/, verdict). A null url, or one without ://, has an empty host and
    path, no rule, and is allowed. Urls of any length are read whole. Repeated rows and null ids come
    back as they are; an empty table gives no rows; further columns are not read.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        host, _, path = rule.partition("/")
        by_host.setdefault(host, []).append((f"/{path}", rule, verdict))

    def run(batches):
        a = automaton(strict, soft)
        for b in batches:
            out = []
            for url in b.column("url").to_pylist():
                host, path, rest = split_url(url)
                found = rule_of(by_host, host, path)
                out.append((host, path, *(found or (None, "block" if vocabulary_blocks(a, rest, limit) else "allow"))))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, pa.string()) for c in cols)], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
