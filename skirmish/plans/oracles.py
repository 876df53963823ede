"""The registered queries in plain SQL, for side-by-side checks.

``CTE`` holds the shared steps; ``sql`` puts the needed ones in front of a select.
"""

from __future__ import annotations

import re

# Fixed values, written out here so that the SQL does not share the code's constants.
VERBS_3RD = (
    "slashes", "crushes", "punches", "pierces", "claws", "kicks", "bites", "hits", "gores",
    "strikes", "mauls", "smashes", "stings", "backstabs", "frenzies on", "maims", "slices",
    "bashes", "shoots", "rends", "stabs",
)
VERBS_1ST = (
    "slash", "crush", "punch", "pierce", "claw", "kick", "bite", "hit", "gore", "strike", "maul",
    "smash", "sting", "backstab", "frenzy on", "maim", "slice", "bash", "shoot", "rend", "stab",
)
SPECIALS_SEEN = ("Headshot", "Twincast", "Rampage")
OUTCOMES = ("miss", "riposte", "parry", "block", "dodge", "rune", "invulnerable")
MOBS = ("a marsh rat", "A marsh rat", "Varn, Last Warden", "Grix Thule-Bane")
TYPED_DAMAGE = ("fire", "cold", "magic")

GAP = 10800
MIN_DAMAGE = 1000
WIDTH = 1800


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CTE: dict[str, str] = {}

CTE["base"] = f"""
SELECT event_id AS e, user_id AS u, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
       event_type AS kind, date_trunc('second', ts) AS ts, CAST(round(value * 100) AS BIGINT) AS amt,
       user_id // 10 AS log_no,
       'Hero' || translate(CAST(user_id // 10 AS VARCHAR), '0123456789', 'abcdefghij') AS char_name
FROM events"""
CTE["base2"] = f"""
SELECT *, 'eqlog_' || char_name || '_north.txt' AS log_id,
  CASE u % 10 WHEN 0 THEN 'You' WHEN 1 THEN char_name || '`s pet' WHEN 2 THEN 'Ember Golem'
       ELSE 'User' || u END AS player,
  CASE WHEN kind = 'click' THEN 'melee_hit'
       WHEN kind = 'view' AND k % 20 = 0 THEN 'resist' WHEN kind = 'view' AND k % 20 = 1 THEN 'zone'
       WHEN kind = 'view' AND k % 20 = 2 THEN 'unknown' WHEN kind = 'view' THEN 'melee_miss'
       WHEN kind = 'signup' THEN 'heal' WHEN kind = 'error' THEN 'death'
       WHEN k % 10 < 5 THEN 'typed' WHEN k % 10 < 7 THEN 'dot' WHEN k % 10 = 7 THEN 'shield'
       WHEN k % 10 = 8 THEN 'nonmelee' WHEN e % 3 = 0 THEN 'bare' WHEN e % 3 = 1 THEN 'falling'
       ELSE 'bleed' END AS form,
  {_list(MOBS)}[k % 4 + 1] AS mob,
  ['active', 'passive', 'proc'][k % 3 + 1] AS heal_form
FROM base"""
CTE["base3"] = """
SELECT *, (e % 4 = 0 AND form IN ('melee_hit', 'melee_miss', 'typed', 'death')) AS mob_acts FROM base2"""
CTE["base4"] = """
SELECT *,
  CASE WHEN form IN ('zone', 'unknown') THEN NULL WHEN form = 'resist' THEN 'You'
       WHEN form IN ('nonmelee', 'bare') THEN '(unattributed)' WHEN form = 'falling' THEN '(falling)'
       WHEN form = 'bleed' THEN '(unconscious)'
       WHEN mob_acts THEN CASE WHEN e % 89 = 0 THEN mob || '`s corpse' ELSE mob END
       ELSE player END AS actor,
  CASE WHEN form IN ('zone', 'unknown') THEN NULL WHEN form IN ('bare', 'falling', 'bleed') THEN 'You'
       WHEN form = 'heal' THEN CASE WHEN heal_form = 'proc' OR e % 5 = 0 THEN player
            WHEN e % 5 = 1 AND heal_form = 'active' THEN 'you' WHEN e % 5 = 1 THEN 'You'
            ELSE 'User' || (log_no * 10 + 3 + e % 7) END
       WHEN mob_acts THEN CASE WHEN player = 'You' THEN CASE WHEN form = 'death' THEN 'You' ELSE 'YOU' END
            ELSE player END
       ELSE mob END AS target,
  form IN ('typed', 'dot', 'shield', 'nonmelee', 'bare', 'falling', 'bleed') AS damaging
FROM base3"""
CTE["ev"] = f"""
SELECT log_id, char_name, e AS ord, ts, epoch_ms(ts) // 1000 AS t,
  CASE WHEN damaging THEN 'spell_damage' ELSE form END AS event_type, actor, target,
  CASE WHEN damaging OR form IN ('melee_hit', 'heal') THEN amt END AS amount,
  CASE WHEN form NOT IN ('melee_hit', 'melee_miss') THEN NULL
       WHEN form = 'melee_miss' OR actor = 'You' THEN {_list(VERBS_1ST)}[k % 21 + 1]
       ELSE {_list(VERBS_3RD)}[k % 21 + 1] END AS verb,
  CASE WHEN form IN ('typed', 'dot', 'resist') THEN 'Spell ' || (k % 12) WHEN form = 'shield' THEN 'thorns'
       WHEN form = 'bleed' THEN 'Pain and suffering'
       WHEN form = 'heal' AND (heal_form = 'proc' OR k % 4 <> 0) THEN 'Mending ' || (k % 5) END AS spell,
  CASE WHEN form = 'typed' THEN {_list(TYPED_DAMAGE)}[k % 3 + 1] WHEN form = 'dot' THEN 'dot'
       WHEN form IN ('shield', 'nonmelee', 'bare') THEN 'non-melee' WHEN form = 'falling' THEN 'falling'
       WHEN form = 'bleed' THEN 'unconscious' END AS damage_type,
  CASE WHEN form = 'melee_miss' THEN {_list(OUTCOMES)}[e % 7 + 1] END AS outcome,
  CASE WHEN form IN ('melee_hit', 'melee_miss', 'heal') OR damaging THEN
       CASE WHEN form IN ('nonmelee', 'bleed') THEN CAST([] AS VARCHAR[]) ELSE
         list_concat(
           CASE WHEN e % 5 = 0 THEN ['Critical'] WHEN e % 7 = 0 THEN ['Lucky Critical Headshot'] ELSE [] END,
           CASE WHEN e % 11 = 0 THEN ['Twincast'] WHEN e % 13 = 0 THEN ['Crippling Blow Rampage'] ELSE [] END)
       END END AS modifiers,
  CASE WHEN form = 'death' THEN target = 'You' END AS you_died,
  CASE WHEN form = 'zone' THEN 'Zone ' || k END AS zone,
  CASE WHEN form = 'unknown' THEN 'Note ' || e || ' of ' || k END AS body
FROM base4"""
CTE["own"] = """
SELECT DISTINCT log_id, 'ember golem' AS who, 'User' || (log_no * 10 + 4) AS owner FROM base2"""
# islands per target
CTE["ad"] = """
SELECT *, event_type = 'death' AS is_death,
  lag(t) OVER w AS pt, lag(event_type = 'death') OVER w AS pd
FROM ev WHERE event_type IN ('melee_hit', 'spell_damage', 'melee_miss', 'death')
WINDOW w AS (PARTITION BY log_id, target ORDER BY ord)"""
CTE["tg"] = f"""
SELECT *, is_death AND (pt IS NULL OR pd) AS late,
  max(CASE WHEN NOT is_death AND (pt IS NULL OR pd OR t - pt > {GAP}) THEN ord END)
    OVER (PARTITION BY log_id, target ORDER BY ord ROWS UNBOUNDED PRECEDING) AS open_ord
FROM ad"""
CTE["fb"] = """
SELECT log_id, target, open_ord, arg_min(t, ord) AS start_t,
  coalesce(max(CASE WHEN is_death THEN t END), max(t)) AS end_t,
  max(CASE WHEN is_death THEN ord END) AS death_ord,
  CAST(coalesce(sum(amount), 0) AS BIGINT) AS total_damage,
  count(*) FILTER (event_type IN ('melee_hit', 'spell_damage')) AS hits,
  count(*) FILTER (event_type = 'melee_miss') AS misses
FROM tg WHERE NOT late GROUP BY ALL"""
CTE["fc"] = """
SELECT *, coalesce(death_ord, lead(open_ord) OVER (PARTITION BY log_id, target ORDER BY open_ord),
                   9223372036854775807) AS close_ord
FROM fb"""
CTE["flip"] = f"""
SELECT DISTINCT f.log_id, f.target, f.open_ord FROM fc f
JOIN tg d ON d.late AND d.log_id = f.log_id AND d.target = f.target AND f.death_ord IS NULL
  AND f.close_ord < d.ord AND d.t - f.end_t <= {GAP} + 10
WHERE NOT EXISTS (SELECT 1 FROM fc g WHERE g.log_id = f.log_id AND g.close_ord < d.ord
  AND (g.close_ord > f.close_ord OR (g.close_ord = f.close_ord AND g.open_ord > f.open_ord))
  AND d.t - g.end_t > {GAP} + 10)"""
CTE["fx"] = """
SELECT f.*, f.death_ord IS NOT NULL OR p.open_ord IS NOT NULL AS fight_complete
FROM fc f LEFT JOIN flip p USING (log_id, target, open_ord)"""


def _fights(extra: str = "TRUE") -> str:
    return f"""
SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY start_t, close_ord, open_ord) AS fight_id,
  end_t - start_t AS duration_seconds, lower(target) || '|' ||
  strftime(make_timestamp(start_t * 1000000), '%Y-%m-%dT%H:%M:%S') AS fight_key
FROM fx WHERE total_damage >= {MIN_DAMAGE} AND target <> 'You' AND NOT ends_with(target, '`s pet') AND {extra}"""


CTE["ft"] = _fights()
CTE["log_end"] = "SELECT log_id, arg_max(t, ord) AS last_t FROM ev GROUP BY ALL"
CTE["alive"] = f"""
SELECT f.log_id, f.target, f.open_ord FROM fx f JOIN log_end USING (log_id)
WHERE close_ord = 9223372036854775807 AND last_t - end_t <= {GAP}"""
# encounters
CTE["run"] = """
SELECT *, max(end_t) OVER (PARTITION BY log_id ORDER BY fight_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_t FROM ft"""
CTE["mb"] = """
SELECT *, CAST(sum(CASE WHEN before_t IS NULL OR start_t - before_t > 0 THEN 1 ELSE 0 END)
  OVER (PARTITION BY log_id ORDER BY fight_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS encounter_id,
  CAST(NULL AS VARCHAR) AS manual_name FROM run"""
CTE["eb"] = """
SELECT log_id, encounter_id, min(start_t) AS s, max(end_t) AS x, max(end_t) - min(start_t) AS dur,
  CAST(sum(total_damage) AS BIGINT) AS total_damage, bool_or(fight_complete) AS fight_complete,
  count(*) AS member_count, count(DISTINCT lower(target)) AS target_count
FROM mb GROUP BY ALL"""
CTE["act"] = f"""
SELECT g.log_id, m.fight_id, m.encounter_id, g.ord, g.t, g.event_type,
  coalesce(o.owner, g.actor) AS actor, g.actor AS raw_actor,
  CASE WHEN o.owner IS NOT NULL THEN g.actor END AS pet_origin, g.target, g.amount, g.verb, g.spell,
  g.outcome, g.modifiers, m.start_t AS fs, m.end_t AS fe, b.s AS es, b.x AS ee, b.dur,
  [s for s in {_list(SPECIALS_SEEN)} if contains(array_to_string(g.modifiers, chr(10)), s)] AS specials,
  g.event_type <> 'melee_miss' AS hit
FROM tg g JOIN mb m USING (log_id, target, open_ord) JOIN eb b ON b.log_id = m.log_id AND b.encounter_id = m.encounter_id
LEFT JOIN own o ON o.log_id = g.log_id AND o.who = lower(g.actor)
WHERE NOT g.late AND NOT g.is_death"""
CTE["hl"] = """
SELECT e.log_id, e.ord, e.t, coalesce(o.owner, e.actor) AS actor,
  CASE WHEN o.owner IS NOT NULL THEN e.actor END AS pet_origin, e.target, e.amount, e.spell, e.modifiers,
  b.encounter_id, b.s AS es, b.x AS ee, b.dur
FROM ev e JOIN (SELECT v.log_id, v.ord, min(b.encounter_id) AS encounter_id FROM ev v
      JOIN eb b ON b.log_id = v.log_id AND v.t BETWEEN b.s AND b.x WHERE v.event_type = 'heal' GROUP BY ALL) q
  USING (log_id, ord)
JOIN eb b ON b.log_id = e.log_id AND b.encounter_id = q.encounter_id
LEFT JOIN own o ON o.log_id = e.log_id AND o.who = lower(e.actor)"""
CTE["dealt"] = """
SELECT log_id, encounter_id, lower(actor) AS who, coalesce(sum(amount), 0) AS dealt FROM act GROUP BY ALL"""
CTE["enc_name"] = """
SELECT log_id, encounter_id, coalesce(max(manual_name), arg_max(target, rk)) AS base_name FROM (
  SELECT *, row_number() OVER (PARTITION BY log_id, encounter_id ORDER BY enemy, total_damage, -fight_id) AS rk
  FROM (SELECT m.*, lower(m.target) <> 'you' AND NOT ends_with(m.target, '`s pet')
          AND m.total_damage > coalesce(d.dealt, 0) AS enemy
        FROM mb m LEFT JOIN dealt d ON d.log_id = m.log_id AND d.encounter_id = m.encounter_id AND d.who = lower(m.target)))
GROUP BY ALL"""
CTE["enc"] = """
SELECT b.*, n.base_name || CASE WHEN target_count > 1 THEN ' +' || (target_count - 1) ELSE '' END AS name,
  coalesce(h.healing, 0) AS total_healing, coalesce(a.n, 0) AS attacker_count,
  CASE WHEN dur > 0 THEN total_damage / dur ELSE 0.0 END AS raid_dps
FROM eb b JOIN enc_name n USING (log_id, encounter_id)
LEFT JOIN (SELECT log_id, encounter_id, CAST(sum(amount) AS BIGINT) AS healing FROM hl GROUP BY ALL) h USING (log_id, encounter_id)
LEFT JOIN (SELECT log_id, encounter_id, count(DISTINCT actor) AS n FROM act GROUP BY ALL) a USING (log_id, encounter_id)"""
CRIT = "len([m for m in modifiers if contains(m, 'Critical') OR contains(m, 'Crippling Blow')]) > 0"
CTE["atk"] = f"""
SELECT log_id, encounter_id, actor, CAST(coalesce(sum(amount), 0) AS BIGINT) AS damage,
  count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (hit AND {CRIT}) AS crits,
  coalesce(max(amount), 0) AS biggest, min(fight_id * 1000000000 + ord) AS seen
FROM act GROUP BY ALL"""
CTE["dp"] = """
SELECT log_id, encounter_id, actor, target, CAST(coalesce(sum(amount), 0) AS BIGINT) AS damage_taken,
  count(*) FILTER (hit) AS hits_landed, coalesce(max(amount), 0) AS biggest_taken, """ + ", ".join(
    f"count(*) FILTER (NOT hit AND outcome = '{o}') AS avoided_{o}" for o in OUTCOMES
) + """,
  count(*) FILTER (NOT hit) AS total_avoided, count(*) AS total_swings, min(fight_id * 1000000000 + ord) AS seen
FROM act GROUP BY ALL"""


def corpse(c: str) -> str:
    return f"(ends_with({c}, '`s corpse') OR ends_with({c}, '''s corpse'))"


CTE["mh"] = f"""
SELECT *, lower(actor) AS ak, lower(target) AS tk FROM act
WHERE hit AND NOT {corpse('actor')} AND NOT {corpse('target')}"""
CTE["mx"] = """
SELECT log_id, encounter_id, ak, tk, CAST(sum(amount) AS BIGINT) AS damage, count(*) AS hits FROM mh GROUP BY ALL"""
CTE["cn"] = """
SELECT log_id, encounter_id, lower(name) AS name_key, arg_min(name, p) AS name FROM (
  SELECT log_id, encounter_id, actor AS name, (fight_id * 1000000000 + ord) * 2 AS p FROM mh
  UNION ALL SELECT log_id, encounter_id, target, (fight_id * 1000000000 + ord) * 2 + 1 FROM mh)
GROUP BY ALL"""
CTE["rcv"] = "SELECT log_id, encounter_id, lower(target) AS name_key, sum(total_damage) AS received FROM mb GROUP BY ALL"
CTE["hld"] = "SELECT log_id, encounter_id, lower(actor) AS name_key, sum(amount) AS healed FROM hl GROUP BY ALL"
CTE["s1"] = f"""
SELECT a.*, lower(actor) AS name_key, coalesce(h.healed, 0) AS healed,
  NOT ends_with(actor, '`s pet') AND coalesce(r.received, 0) > damage + coalesce(h.healed, 0) AS enemy1
FROM atk a LEFT JOIN rcv r ON r.log_id = a.log_id AND r.encounter_id = a.encounter_id AND r.name_key = lower(a.actor)
LEFT JOIN hld h ON h.log_id = a.log_id AND h.encounter_id = a.encounter_id AND h.name_key = lower(a.actor)
WHERE NOT {corpse('a.actor')}"""
CTE["n1"] = """
SELECT log_id, encounter_id, name_key, enemy1 FROM s1
QUALIFY row_number() OVER (PARTITION BY log_id, encounter_id, name_key ORDER BY damage, seen DESC) = 1"""
CTE["aim"] = """
SELECT m.log_id, m.encounter_id, m.ak AS name_key,
  sum(CASE WHEN coalesce(n.enemy1, FALSE) THEN damage ELSE 0 END) AS to_e,
  sum(CASE WHEN coalesce(n.enemy1, FALSE) THEN 0 ELSE damage END) AS to_f
FROM mx m LEFT JOIN n1 n ON n.log_id = m.log_id AND n.encounter_id = m.encounter_id AND n.name_key = m.tk GROUP BY ALL"""
CTE["sd"] = """
SELECT s.log_id, s.encounter_id, s.actor, s.name_key, s.damage, s.seen,
  CASE WHEN enemy1 OR (NOT ends_with(actor, '`s pet') AND healed <= 0 AND coalesce(to_f, 0) > coalesce(to_e, 0))
       THEN 'enemy' ELSE 'friendly' END AS side
FROM s1 s LEFT JOIN aim a USING (log_id, encounter_id, name_key)"""
CTE["sn"] = """
SELECT log_id, encounter_id, name_key, side FROM sd
QUALIFY row_number() OVER (PARTITION BY log_id, encounter_id, name_key ORDER BY damage, seen DESC) = 1"""
CTE["s4"] = """
SELECT log_id, name_key, CASE WHEN NOT ends_with(name_key, '`s pet')
  AND coalesce(sum(v) FILTER (m = 'r'), 0) > coalesce(sum(v) FILTER (m <> 'r'), 0) THEN 'enemy' ELSE 'friendly' END AS side
FROM (SELECT log_id, lower(actor) AS name_key, damage AS v, 'd' AS m FROM atk
      UNION ALL SELECT log_id, lower(target), total_damage, 'r' FROM mb
      UNION ALL SELECT log_id, lower(actor), amount, 'h' FROM hl) GROUP BY log_id, name_key"""
CTE["val"] = """
SELECT 0 AS mode, log_id, encounter_id, lower(actor) AS name_key, arg_min(actor, seen) AS name,
  CAST(sum(damage) AS BIGINT) AS value, max(biggest) AS biggest FROM atk GROUP BY ALL
UNION ALL SELECT 1, log_id, encounter_id, lower(target), arg_min(target, seen), CAST(sum(damage_taken) AS BIGINT),
  max(biggest_taken) FROM dp WHERE damage_taken <> 0 GROUP BY ALL
UNION ALL SELECT 2, log_id, encounter_id, lower(actor), arg_min(actor, ord), CAST(sum(amount) AS BIGINT), max(amount)
  FROM hl GROUP BY ALL"""
CTE["rt"] = """
SELECT v.*, CAST(round_even(value / CASE WHEN dur = 0 THEN 1 ELSE dur END, 0) AS BIGINT) AS rate
FROM val v JOIN eb USING (log_id, encounter_id)"""
CTE["ru"] = """
SELECT r.mode, r.log_id, r.name_key, arg_min(name, encounter_id) AS name, CAST(sum(value) AS BIGINT) AS total,
  max(biggest) AS biggest, count(*) FILTER (rate > 0) AS encounters_present,
  CAST(round_even(avg(rate) FILTER (rate > 0), 0) AS BIGINT) AS avg_rate,
  CAST(round_even(quantile_cont(rate, 0.5) FILTER (rate > 0), 0) AS BIGINT) AS median_rate,
  list_sort(list(rate) FILTER (rate > 0), 'DESC')[
    CASE WHEN count(*) FILTER (rate > 0) >= 20 THEN CAST(floor(count(*) FILTER (rate > 0) * 0.05) AS BIGINT) + 1 ELSE 1 END] AS p95_rate,
  max(rate) FILTER (rate > 0) AS best_rate
FROM rt r GROUP BY ALL HAVING count(*) FILTER (rate > 0) > 0"""
CTE["rs"] = """
SELECT r.*, coalesce(s.side, 'friendly') AS side FROM ru r LEFT JOIN s4 s USING (log_id, name_key)"""


def sql(select: str, **extra: str) -> str:
    """``select`` behind every shared step it needs; ``extra`` replaces or adds steps."""
    steps = {**CTE, **extra}
    need: set[str] = set()

    def visit(text: str) -> None:
        for n in set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", text)):
            if n in steps and n not in need:
                need.add(n)
                visit(steps[n])

    visit(select)
    order: list[str] = []

    def place(n: str) -> None:
        if n in order:
            return
        for m in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", steps[n]):
            if m in need and m != n:
                place(m)
        order.append(n)

    for n in steps:
        if n in need:
            place(n)
    head = ",\n".join(f"{n} AS ({steps[n].strip()})" for n in order)
    recursive = "RECURSIVE " if any(re.search(rf"\bFROM {n}\b", steps[n]) for n in order) else ""
    return f"WITH {recursive}{head}\n{select.strip()}" if head else select.strip()
