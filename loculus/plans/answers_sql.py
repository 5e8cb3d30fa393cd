"""SQL of queries whose text is long: answers of the filtered and the agent family, prompts, boxes and maps."""

from __future__ import annotations

from loculus.functions.tables import CHOICE_TASKS, NUMERIC_TASKS
from loculus.functions.texts import NEEDS
from loculus.operators.family_answers import COMMON, NO_NAMES
from loculus.plans.answer_queries import ANSWERS, LAB, NUM, PICK
from loculus.plans.family_queries import KEN
from loculus.plans.fixtures import d4, vt, with_ctes
from loculus.plans.registry import QUERIES, SQL
from loculus.plans.space_queries import BOX, SIZE


def gap(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.m{c} - {b}.m{c}) * ({a}.m{c} - {b}.m{c})" for c in "xyz") + ")"


def text(*parts: str) -> str:
    """Words in quotes and columns as they are, put together."""
    return " || ".join(p if p in {"label", "l1", "l2", "l3", "l4", "k", "word"} else "'" + p + "'" for p in parts)


STAND = ("If I am standing by the ", "label", " and facing the ", "l1", ", is the ", "l2", " to ")
WORD = "CASE WHEN k % 2 = 0 THEN 'closest to' ELSE 'farthest from' END"
LISTS = [f"'{x}. ' || " + " || ', ' || ".join(r) for x, r in zip("ABCD", (("label", "l1", "l2", "l3"), ("l1", "label", "l3", "l2"), ("l3", "l2", "l1", "label"), ("l2", "l3", "label", "l1")))]
FIXED = {"easy": ["A. left", "B. right"], "medium": ["A. left", "B. right", "C. back"], "hard": ["A. front-left", "B. front-right", "C. back-left", "D. back-right"]}
KINDS = [
    ("count", text("How many ", "label", "(s) are in this room?"), None, 0),
    ("none", text("How many zebras", "k", " are in this room?"), None, 0),
    ("size", text("What is the size of the ", "label", "?"), None, 0),
    ("room", text("What is the size of this room (in square meters)? ", "label"), None, 0),
    ("dist", text("Measuring from the closest point of each object, what is the distance between the ", "label", " and the ", "l1", " (in meters)?"), None, 1),
    ("easy", text(*STAND, "the left or the right of the ", "l1", "?"), str(FIXED["easy"]), 2),
    ("medium", text(*STAND, "my left, right, or back?"), str(FIXED["medium"]), 2),
    ("hard", text(*STAND, "my front-left, front-right, back-left, or back-right?"), str(FIXED["hard"]), 2),
    ("rel", f"'Which of these objects is the ' || {WORD} || ' the ' || label || '?'", "['A. ' || l1, 'B. ' || l2, 'C. ' || l3, 'D. ' || l4]", 4),
    ("order", text("What will be the first-time appearance order of the following categories in the video: ", "l1", ", ", "label", ", ", "l3", ", ", "l2", "?"), f"[{', '.join(LISTS)}]", 3),
    ("route", text("You are a robot beginning at the ", "label", " facing the ", "l1", ". You want to navigate to the ", "l3", ". You will perform the following actions: 1. [please fill in] 2. Go forward until the ", "l2", " 3. [please fill in] 4. Go forward until the ", "l3", "."), "['A. Turn Left, Turn Right', 'B. Turn Right, Turn Left', 'C. Turn Back, Turn Left', 'D. Turn Left, Turn Left']", 3),
]
#: All questions: kind, scene, k, question, options.
QST = "qst", " UNION ALL ".join(f"SELECT '{kind}' AS kind, scene, k, {question} AS question, {options or 'NULL::VARCHAR[]'} AS options FROM lab WHERE {f'l{need}' if need else 'label'} IS NOT NULL" for kind, question, options, need in KINDS)
SMS = "sms", "SELECT scene, label, w.m AS w_mean, h.m AS h_mean FROM (SELECT scene, label, " + ", ".join(f"list_reduce(l{c}, lambda a, x: {{'m': (a.m * (n - 1) + x.m) / n}}) AS {c}" for c in "wh") + " FROM (SELECT scene, label, count(*)::DOUBLE AS n, list({'m': width_3d} ORDER BY det_ord) AS lw, list({'m': height_3d} ORDER BY det_ord) AS lh FROM det GROUP BY ALL))"


#: Of each query here its last select, and the tables that it alone has.
RAW: dict[str, tuple[str, list[tuple[str, str]]]] = {}


def add(name: str, sql: str, *more: tuple[str, str]) -> None:
    if name not in QUERIES or name in SQL:
        raise ValueError(name)
    RAW[name] = sql, [m for m in more if m not in (*KEN, QST, SMS)]
    SQL[name] = with_ctes(sql, *more)


add("q_b2_object_size", f"""SELECT 'size-' || q.scene || '-' || q.k AS qid, CAST(trunc(greatest(w_mean, h_mean, 0.3) * 100) AS INTEGER)::VARCHAR AS answer, {d4('least(1.0, confidence * obs_count / 10)')} AS sure
FROM (SELECT qst.scene, k, arg_min(label, entity_ord) AS label FROM qst JOIN ken ON ken.scene = qst.scene AND contains(lower(question), lower(label)) WHERE kind = 'size' GROUP BY qst.scene, k) q JOIN ken ON ken.scene = q.scene AND ken.label = q.label JOIN sms ON sms.scene = q.scene AND sms.label = q.label""", *KEN, QST, SMS)

add("q_b5_direction_easy", f"""SELECT 'easy-' || lab.scene || '-' || lab.k AS qid, CASE WHEN rgt > 0 THEN 'B. right' ELSE 'A. left' END AS answer, {d4('CASE WHEN rgt IS NULL THEN 0.3 ELSE spread * greatest(abs(rgt), abs(front)) * CASE WHEN over > 0.5 THEN 0.5 ELSE 1.0 END END')} AS sure
FROM lab LEFT JOIN (SELECT scene, k, spread, over, (tx * fx + tz * fz) / (nf * nt) AS front, (tx * fz - tz * fx) / (nf * nt) AS rgt FROM (SELECT *, sqrt(fx * fx + fz * fz) AS nf, sqrt(tx * tx + tz * tz) AS nt FROM
 (SELECT lab.scene, k, f.mx - o.mx AS fx, f.mz - o.mz AS fz, t.mx - f.mx AS tx, t.mz - f.mz AS tz, 1 / (1 + o.sigma + f.sigma + t.sigma) AS spread, exp(-{gap('o', 't')} / (o.sigma + t.sigma)) AS over
  FROM lab JOIN kfs o ON o.scene = lab.scene AND o.name = lab.label JOIN kfs f ON f.scene = lab.scene AND f.name = lab.l1 JOIN kfs t ON t.scene = lab.scene AND t.name = lab.l2)) WHERE nf >= 1e-6 AND nt >= 1e-6) v ON v.scene = lab.scene AND v.k = lab.k WHERE l2 IS NOT NULL""", *KEN)

add("q_b6_rel_distance", f"""SELECT 'rel-' || scene || '-' || k AS qid, arg_min(opt, (d, letter)) AS answer, {d4('arg_min(s, (d, letter))')} AS sure FROM (SELECT lab.scene, k, o.letter, o.letter || '. ' || o.name AS opt, CASE WHEN k % 2 = 0 THEN {gap('a', 'b')} ELSE -{gap('a', 'b')} END AS d, 1 / (1 + a.sigma + b.sigma) AS s
FROM lab, LATERAL (VALUES ('A', l1), ('B', l2), ('C', l3), ('D', l4)) o(letter, name) JOIN kfs a ON a.scene = lab.scene AND a.name = lab.label JOIN kfs b ON b.scene = lab.scene AND b.name = o.name WHERE l4 IS NOT NULL) GROUP BY scene, k""", *KEN)

add("q_b7_order", f"""SELECT 'order-' || scene || '-' || k AS qid, arg_max(opt, (p, -o)) AS answer, {d4('least(1.0, any_value(seen) / 10)')} AS sure FROM (SELECT scene, k, o, any_value(opt) AS opt, any_value(seen) AS seen, sum(greatest(0, 4 - abs(i - j))) AS p FROM
 (SELECT q.scene, q.k, v.o, u.i, any_value(v.opt) AS opt, any_value(q.seen) AS seen, min(w.j) AS j FROM (SELECT lab.scene, k, any_value(label) AS l0, any_value(l1) AS l1, any_value(l2) AS l2, any_value(l3) AS l3, list(n.name ORDER BY kfs.first_seen, n.i) AS s, avg(obs_count) AS seen
   FROM lab, LATERAL (VALUES (0, l1), (1, label), (2, l3), (3, l2)) n(i, name) JOIN kfs ON kfs.scene = lab.scene AND kfs.name = n.name WHERE l3 IS NOT NULL GROUP BY lab.scene, k) q,
  LATERAL (VALUES (0, 'A. ' || l0 || ', ' || l1 || ', ' || l2 || ', ' || l3, [l0, l1, l2, l3]), (1, 'B. ' || l1 || ', ' || l0 || ', ' || l3 || ', ' || l2, [l1, l0, l3, l2]), (2, 'C. ' || l3 || ', ' || l2 || ', ' || l1 || ', ' || l0, [l3, l2, l1, l0]), (3, 'D. ' || l2 || ', ' || l3 || ', ' || l0 || ', ' || l1, [l2, l3, l0, l1])) v(o, opt, items),
  LATERAL (SELECT unnest([0, 1, 2, 3]) AS i) u, LATERAL (SELECT unnest([0, 1, 2, 3]) AS j) w JOIN mat ON mat.name = q.s[u.i + 1] AND mat.label = v.items[w.j + 1] GROUP BY q.scene, q.k, v.o, u.i) GROUP BY scene, k, o) GROUP BY scene, k""", *KEN)

TGT = "tgt", "SELECT scene, k, name, min(i) AS i FROM (SELECT scene, k, c.name, c.i FROM qst, (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(COMMON)) + ") c(i, name) WHERE kind = 'dist' AND contains(lower(question), c.name) UNION ALL SELECT scene, k, name, i FROM (SELECT scene, k, unnest(regexp_extract_all(lower(question), 'the (\\w+)', 1)) AS name, 100 + unnest(range(len(regexp_extract_all(lower(question), 'the (\\w+)', 1)))) AS i FROM qst WHERE kind = 'dist') WHERE name NOT IN (" + ", ".join(f"'{n}'" for n in NO_NAMES) + ")) GROUP BY scene, k, name"
FIRST = ", ".join(f"arg_min({c}, entity_ord) AS {c}" for c in ("mx", "my", "mz", "pc"))
add("q_c2_abs_distance", f"""SELECT 'dist-' || q.scene || '-' || q.k AS qid, CASE WHEN b.pc IS NULL THEN '2.0' ELSE printf('%.1f', {gap('a', 'b')}) END AS answer, {d4('CASE WHEN b.pc IS NULL THEN 0.3 ELSE least(a.pc, b.pc) END')} AS sure FROM (SELECT scene, k FROM qst WHERE kind = 'dist') q LEFT JOIN hit a ON a.scene = q.scene AND a.k = q.k AND a.n = 1 LEFT JOIN hit b ON b.scene = q.scene AND b.k = q.k AND b.n = 2""",
    *KEN, QST, TGT, ("cnt", f"SELECT t.scene, name, {FIRST} FROM (SELECT DISTINCT scene, name FROM tgt) t JOIN ken ON ken.scene = t.scene AND (contains(lower(label), name) OR contains(name, lower(label))) GROUP BY t.scene, name"),
    ("hit", "SELECT tgt.scene, k, row_number() OVER (PARTITION BY tgt.scene, k ORDER BY i) AS n, cnt.* EXCLUDE (scene, name) FROM tgt JOIN cnt ON cnt.scene = tgt.scene AND cnt.name = tgt.name"))

PARTS = "SELECT kind, scene, k, options, " + ", ".join(f"nullif(regexp_extract(lower(question), '{p}', 1), '') AS {c}" for c, p in (("o", r"standing by (?:the )?(\w+)"), ("f", r"facing (?:the )?(\w+)"), ("t", r"is (?:the )?(\w+) (?:on|to)"))) + " FROM qst WHERE kind IN ('easy', 'medium', 'hard')"
add("q_c5_direction", f"""SELECT kind || '-' || scene || '-' || k AS qid, CASE WHEN rgt IS NULL THEN options[1] ELSE list_filter(options, lambda x: contains(lower(x), word))[1] END AS answer, {d4('CASE WHEN rgt IS NULL THEN 0.3 ELSE pc END')} AS sure FROM (SELECT *, CASE kind WHEN 'easy' THEN side WHEN 'medium' THEN CASE WHEN front < -0.5 THEN 'back' ELSE side END ELSE CASE WHEN front > 0 THEN 'front-' ELSE 'back-' END || side END AS word FROM
 (SELECT *, (tx * fz - tz * fx) / (nf * nt) AS rgt, (tx * fx + tz * fz) / (nf * nt) AS front, CASE WHEN (tx * fz - tz * fx) / (nf * nt) > 0 THEN 'right' ELSE 'left' END AS side FROM (SELECT *, sqrt(fx * fx + fz * fz) + 1e-8 AS nf, sqrt(tx * tx + tz * tz) + 1e-8 AS nt FROM
  (SELECT kind, par.scene, k, options, f.mx - o.mx AS fx, f.mz - o.mz AS fz, t.mx - o.mx AS tx, t.mz - o.mz AS tz, CASE WHEN o.pc IS NOT NULL AND f.pc IS NOT NULL AND t.pc IS NOT NULL THEN least(o.pc, f.pc, t.pc) END AS pc
   FROM par LEFT JOIN cnt o ON o.scene = par.scene AND o.name = par.o LEFT JOIN cnt f ON f.scene = par.scene AND f.name = par.f LEFT JOIN cnt t ON t.scene = par.scene AND t.name = par.t))))""",
    *KEN, QST, ("par", PARTS), ("cnt", f"SELECT t.scene, name, {FIRST} FROM (SELECT scene, o AS name FROM par UNION SELECT scene, f FROM par UNION SELECT scene, t FROM par) t JOIN ken ON ken.scene = t.scene AND (contains(lower(label), name) OR contains(name, lower(label))) GROUP BY t.scene, name"))

add("q_c6_rel_distance", f"""SELECT 'rel-' || q.scene || '-' || q.k AS qid, coalesce(b.answer, q.options[1]) AS answer, CASE WHEN b.answer IS NULL THEN 0.3 ELSE 0.7 END::DOUBLE AS sure FROM (SELECT * FROM qst WHERE kind = 'rel') q LEFT JOIN
 (SELECT scene, k, arg_min(opt, (d, i)) AS answer FROM (SELECT r.scene, r.k, r.i, r.opt, CASE WHEN far THEN -{gap('a', 'b')} ELSE {gap('a', 'b')} END AS d FROM
  (SELECT scene, k, unnest(options) AS opt, unnest(range(len(options))) AS i, regexp_extract(lower(question), '(closest|nearest|farthest) to (?:the )?(\\w+)', 2) AS ref, regexp_extract(lower(question), '(closest|nearest|farthest) to (?:the )?(\\w+)', 1) = 'farthest' AS far FROM qst WHERE kind = 'rel') r
  JOIN (SELECT w.scene, w.ref, arg_min(mx, entity_ord) AS mx, arg_min(my, entity_ord) AS my, arg_min(mz, entity_ord) AS mz FROM (SELECT DISTINCT scene, regexp_extract(lower(question), '(closest|nearest|farthest) to (?:the )?(\\w+)', 2) AS ref FROM qst WHERE kind = 'rel') w JOIN ken ON ken.scene = w.scene AND contains(lower(label), ref) WHERE ref <> '' GROUP BY w.scene, w.ref) a ON a.scene = r.scene AND a.ref = r.ref
  JOIN (SELECT o.scene, o.opt, arg_min(mx, entity_ord) AS mx, arg_min(my, entity_ord) AS my, arg_min(mz, entity_ord) AS mz FROM (SELECT DISTINCT scene, unnest(options) AS opt FROM qst WHERE kind = 'rel') o JOIN ken ON ken.scene = o.scene AND contains(lower(o.opt), lower(label)) GROUP BY o.scene, o.opt) b ON b.scene = r.scene AND b.opt = r.opt) GROUP BY scene, k) b ON b.scene = q.scene AND b.k = q.k""", *KEN, QST)

add("x14_prompts", "SELECT kind || '-' || scene || '-' || k AS qid, 'You see a video of an indoor scene.' || chr(10) || 'Question: ' || question || CASE WHEN options IS NULL THEN chr(10) || 'Answer with one number.' ELSE chr(10) || 'Options:' || chr(10) || array_to_string(options, chr(10)) || chr(10) || 'Answer with the letter alone.' END AS prompt FROM qst", *LAB, QST)

add("a12_half_open_boxes", f"SELECT DISTINCT scene, vx, vy, vz FROM (SELECT scene, {vt('mx - w3 / 2 + i * 0.5', SIZE)}::INTEGER AS vx, {vt('my - h3 / 2 + j * 0.5', SIZE)}::INTEGER AS vy, {vt('mz - 0.3::DOUBLE / 2', SIZE)}::INTEGER AS vz FROM (SELECT *, unnest(range(ceil(w3 / {SIZE})::BIGINT)) AS i FROM ent), LATERAL (SELECT unnest(range(ceil(h3 / {SIZE})::BIGINT)) AS j))")

SQL["e8_median_vote"] = "SELECT user_id AS qid, round(median(CASE WHEN v BETWEEN 1 AND 200 THEN v END)::DECIMAL(18, 6), 1)::DECIMAL(18, 1)::VARCHAR AS answer FROM (SELECT user_id, round(value::DECIMAL(18, 6), 1)::DOUBLE AS v FROM events) GROUP BY user_id"

add("s28_markdown_prompt", "SELECT scene, '| id | category | position | count |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || entity_id || ' | ' || label || ' | (' || " + " || ', ' || ".join(f"round(m{c}::DECIMAL(18, 9), 2)::DECIMAL(18, 2)::VARCHAR" for c in "xyz") + " || ') | ' || count_in_frame || ' |', chr(10) ORDER BY entity_ord) AS text FROM ent GROUP BY scene")

LINES = {"count": "printf('  count: %d', count_in_frame)", "position": "printf('  position (x,y,z): (%.2f, %.2f, %.2f) m', mx, my, mz)", "size": "printf('  size (w,h,d): (%.2f, %.2f, %.2f) m', w3, h3, 0.3)", "frames": "printf('  first frame: %d', first_seen)"}
add("s30_task_text", "SELECT scene, string_agg(concat_ws(chr(10), printf('- %s:', label), " + ", ".join(v for k, v in LINES.items() if k in NEEDS["object_counting"]) + "), chr(10) ORDER BY entity_ord) AS text FROM ent GROUP BY scene")

VIEW = "pro", f"SELECT scene, frame_order, label, {d4('500 * (mx - cx) / n + 320')} AS u, {d4('500 * (my - cy) / n + 240')} AS v FROM (SELECT ent.scene, frame_order, label, mx, my, mz, cx, cy, cz, sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy) + (mz - cz) * (mz - cz)) AS n FROM ent JOIN cam ON cam.scene = ent.scene) WHERE mz - cz >= 0 AND n >= 0.1"
add("p22_projection", "SELECT * FROM pro", VIEW)
add("j10_labels_by_boxes", f"""SELECT scene, frame, thing, CASE WHEN held IS NOT NULL THEN held.label WHEN far < 192 THEN near.label ELSE 'object' END AS label, {d4('CASE WHEN held IS NOT NULL THEN held.confidence WHEN far < 192 THEN near.confidence * 0.5 WHEN n > 0 THEN 0.3 ELSE 0.1 END')} AS confidence FROM
 (SELECT scene, frame, thing, count(label) AS n, min(far) AS far, arg_min({{'label': label, 'confidence': confidence}}, (far, label)) AS near, arg_max({{'label': label, 'confidence': confidence}}, (confidence, -share, label)) FILTER (WHERE u BETWEEN x1 AND x2 AND v BETWEEN y1 AND y2) AS held FROM
  (SELECT *, sqrt((u - (x1 + x2) / 2) * (u - (x1 + x2) / 2) + (v - (y1 + y2) / 2) * (v - (y1 + y2) / 2)) AS far, sqrt(((u - (x1 + x2) / 2) / 640) ** 2 + ((v - (y1 + y2) / 2) / 480) ** 2) AS share FROM
   (SELECT p.scene, p.frame_order AS frame, p.label AS thing, u, v, d.label, d.confidence, x * 60 AS x1, y * 150 AS y1, x * 60 + width_3d * 60 AS x2, y * 150 + height_3d * 60 AS y2 FROM pro p LEFT JOIN det d ON d.scene = p.scene AND d.frame_order = p.frame_order)) GROUP BY scene, frame, thing)""", VIEW)

add("x17_letter_map", """SELECT r.scene, r.cz::INTEGER AS cz, string_agg(coalesce(c, '.'), '' ORDER BY i) AS line FROM (SELECT *, unnest(range(least(29, x1 - x0) + 1)) AS i FROM (SELECT DISTINCT scene, cz FROM cel) JOIN low USING (scene)) r LEFT JOIN cel ON cel.scene = r.scene AND cel.cz = r.cz AND cel.cx = r.i GROUP BY r.scene, r.cz""",
    BOX, ("low", "SELECT scene, min(vx) AS x0, max(vx) AS x1, min(vz) AS z0 FROM box GROUP BY scene"), ("cel", "SELECT scene, vx - x0 AS cx, vz - z0 AS cz, upper(substr(max(label), 1, 1)) AS c FROM box JOIN low USING (scene) WHERE vx - x0 < 30 AND vz - z0 < 30 GROUP BY ALL"))

TURNS = "(0, 'A', 'l', 'r'), (1, 'B', 'r', 'l'), (2, 'C', 'b', 'l'), (3, 'D', 'l', 'l')"


def turned(command: str, x: str, z: str) -> tuple[str, str]:
    return f"CASE {command} WHEN 'b' THEN -{x} WHEN 'l' THEN -{z} ELSE {z} END", f"CASE {command} WHEN 'b' THEN -{z} WHEN 'l' THEN {x} ELSE -{x} END"


def gain(x: str, z: str, dx: str, dz: str) -> str:
    n = f"sqrt({dx} * {dx} + {dz} * {dz})"
    dot = f"round(({x} * {dx} + {z} * {dz}) / {n}, 9)"
    return f"CASE WHEN {n} > 1e-8 THEN CASE WHEN {dot} > 0 THEN {dot} ELSE -0.5 END ELSE 0.0 END"


T1, T2 = turned("c1", "fx", "fz"), turned("c2", "gx", "gz")
#: The walk of a route question: its places, the facing at the start, after the first turn (t), and after the first leg (g).
RTE = [
    ("rt0", "SELECT lab.scene, k, s.mx AS sx, s.mz AS sz, f.mx - s.mx AS ax, f.mz - s.mz AS az, v.mx - s.mx AS dx, v.mz - s.mz AS dz, w.mx - v.mx AS ex, w.mz - v.mz AS ez FROM lab JOIN fst s ON s.scene = lab.scene AND s.name = lab.label JOIN fst f ON f.scene = lab.scene AND f.name = lab.l1 JOIN fst v ON v.scene = lab.scene AND v.name = lab.l2 JOIN fst w ON w.scene = lab.scene AND w.name = lab.l3"),
    ("rt1", "SELECT *, sqrt(bx * bx + bz * bz) AS fn, bx / sqrt(bx * bx + bz * bz) AS fx, bz / sqrt(bx * bx + bz * bz) AS fz FROM (SELECT *, CASE WHEN sqrt(ax * ax + az * az) < 1e-8 THEN dx ELSE ax END AS bx, CASE WHEN sqrt(ax * ax + az * az) < 1e-8 THEN dz ELSE az END AS bz FROM rt0)"),
    ("rt2", f"SELECT *, {T1[0]} AS tx, {T1[1]} AS tz, sqrt(dx * dx + dz * dz) AS m FROM rt1, (VALUES {TURNS}) o(o, letter, c1, c2)"),
    ("rt3", f"SELECT *, {gain('tx', 'tz', 'dx', 'dz')} AS p1, CASE WHEN m > 1e-8 THEN dx / m ELSE tx END AS gx, CASE WHEN m > 1e-8 THEN dz / m ELSE tz END AS gz FROM rt2"),
    ("rt4", f"SELECT *, {T2[0]} AS ux, {T2[1]} AS uz FROM rt3"),
    ("rts", f"SELECT lab.scene, lab.k, coalesce(q.letter, 'A') AS answer FROM lab LEFT JOIN (SELECT scene, k, arg_max(letter, (round(p, 9), -o)) AS letter FROM (SELECT scene, k, letter, o, p1 + {gain('ux', 'uz', 'ex', 'ez')} AS p FROM rt4 WHERE fn >= 1e-8) WHERE p > -1 GROUP BY scene, k) q ON q.scene = lab.scene AND q.k = lab.k WHERE lab.l3 IS NOT NULL"),
]
add("q_a8_route", "SELECT 'route-' || scene || '-' || k AS qid, answer FROM rts", *LAB, *RTE)

ROOM = ("rom", f"""SELECT ent.scene, entity_ord AS k, CAST(round_even(area, 0) AS INTEGER)::VARCHAR AS answer FROM ent JOIN (SELECT scene, greatest(5.0, least(80.0, (e[1] + 2.0) * (e[2] + 2.0))) AS area FROM (SELECT scene, list_reverse_sort([x * scf, y * scf, z * scf]) AS e FROM
  (SELECT scene, {", ".join(f"CASE WHEN count(*) >= 10 THEN quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05) ELSE max({c}) - min({c}) END AS {c}" for c in "xyz")} FROM plc GROUP BY scene) JOIN scl USING (scene))) USING (scene)""")
EVERY = {**ANSWERS, "room": ("room", "room_size_estimation", "SELECT * FROM rom", NUM), "route": ("route", "route_planning", "SELECT * FROM rts", PICK.format(n=4))}
NUMERIC = "CASE WHEN g = 0 THEN CASE WHEN p = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_filter(range(10), lambda i: abs(p - g) / (abs(g) + 1e-8) < 1 - (0.05::DOUBLE + i * 0.05::DOUBLE))) / 10.0 END"
ALL = ("every", "SELECT qid, qtype, answer, ground_truth, CASE WHEN qtype IN (" + ", ".join(f"'{t}'" for t in NUMERIC_TASKS) + f") THEN {NUMERIC} WHEN answer = ground_truth THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM (SELECT *, try_cast(answer AS DOUBLE) AS p, try_cast(ground_truth AS DOUBLE) AS g FROM ("
       + " UNION ALL ".join(f"SELECT '{prefix}-' || scene || '-' || k AS qid, '{qtype}' AS qtype, answer, {truth} AS ground_truth FROM ({sql})" for prefix, qtype, sql, truth in EVERY.values()) + "))")
add("q_a9_all_answers", "SELECT * FROM every", *LAB, *RTE, ROOM, ALL)
add("a25_run_summary", f"SELECT kind, qtype, count(*) AS n, {d4('avg(score)')} AS mean_score, {d4('avg((score >= 1)::INTEGER) * 100')} AS percent_full FROM (SELECT *, CASE WHEN qtype IN ({', '.join(repr(t) for t in CHOICE_TASKS)}) THEN 'choice' WHEN qtype IN ({', '.join(repr(t) for t in NUMERIC_TASKS)}) THEN 'numeric' ELSE 'other' END AS kind FROM every) GROUP BY ROLLUP (kind, qtype)", *LAB, *RTE, ROOM, ALL)

add("a26_wins_losses", "SELECT qtype, count(*) AS n, count(*) FILTER (score > ref + 0.05) AS wins, count(*) FILTER (score < ref - 0.05) AS losses FROM (SELECT *, ((split_part(qid, '-', 2)::BIGINT * 7 + split_part(qid, '-', 3)::BIGINT * 3) % 10) / 10.0::DOUBLE AS ref FROM every) GROUP BY qtype", *LAB, *RTE, ROOM, ALL)
