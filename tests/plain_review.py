"""The whole review of one paper in plain Python, for comparison: lists of dicts, one step after the other, no Spark."""

import json

from marginalia.plans import fixed_values as V

CRITERIA = ["importance", "specificity", "actionability", "uniqueness"]
REVERSED = ["uniqueness", "actionability", "specificity", "importance"]
DIMENSIONS = ["contribution", "logical_soundness", "interpretation", "writing_structure"]
#: USD for a million tokens in and out.
PRICES = {"gpt-5.2": (1.75, 14.0), "gpt-5.1": (1.25, 10.0), "gpt-5": (1.25, 10.0), "gpt-5-mini": (0.25, 2.0), "gpt-5-nano": (0.05, 0.4)}


def fill(template, **values):
    """{name} replaced at once, so that braces in values stay; stripped."""
    out, rest = "", template
    while rest:
        name = next((n for n in values if rest.startswith("{" + n + "}")), None)
        out, rest = (out + str(values[name]), rest[len(name) + 2 :]) if name else (out + rest[0], rest[1:])
    return out.strip()


def tight(x):
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


class PlainReview:
    def __init__(self, backend, paper, model=V.GENERATION_MODEL, top_k=5, agents=8, count=len):
        self.backend, self.paper, self.model, self.top_k, self.agents, self.count = backend, paper, model, top_k, agents, count
        self.calls = 0

    def ask(self, stage, model, system, user, as_json=True):
        self.calls += 1
        reply = self.backend.complete(stage, model, system, user, as_json)
        return json.loads(reply) if as_json else reply

    def generation_prompt(self, worker):
        system = V.GENERATION_SYSTEM + (V.PERSONA_JOINT + worker["persona"] if worker["persona"] else "")
        return system, fill(V.GENERATION_PROMPT, paper=self.paper, id=worker["id"])

    def pass_prompt(self, proposal, number):
        blocks = [V.PAPER_BLOCK.replace("{paper}", self.paper), V.PROPOSAL_BLOCK.replace("{dimension}", proposal.get("dimension", "")).replace("{text}", proposal.get("text", ""))]
        rubric = CRITERIA if number == 1 else REVERSED
        context = "\n\n".join(blocks if number == 1 else blocks[::-1])
        return fill(V.ORDERED_PROMPT, rubric="\n".join(V.RUBRIC[k] for k in rubric), context=context)

    def scored(self, proposals, stage):
        out = []
        for p in proposals:
            a, b = (self.ask("scoring", V.SCORING_MODEL, V.SCORING_SYSTEM, self.pass_prompt(p, n)) for n in (1, 2))
            s = {**p, **{k: (int(a[k]) + int(b[k])) / 2.0 for k in CRITERIA}}
            s["judge_disagreement"] = {k: abs(int(a[k]) - int(b[k])) for k in CRITERIA}
            s["composite"] = 0.35 * s["importance"] + 0.25 * s["specificity"] + 0.20 * s["actionability"] + 0.20 * s["uniqueness"]
            out.append(s)
        return out

    def select(self, scored):
        by_composite = sorted(scored, key=lambda p: p["composite"], reverse=True)
        high = [p for p in by_composite if p["composite"] >= 3.0 or p["importance"] >= 3]
        return {
            "sorted": by_composite,
            "top": by_composite[: self.top_k],
            "low_ids": [p["id"] for p in by_composite if p["importance"] <= 2 or p["actionability"] <= 2],
            "high": high,
            "unique": sorted(high, key=lambda p: p["uniqueness"], reverse=True),
            "by_dimension": {d: [p for p in high if p.get("dimension") == d] for d in DIMENSIONS},
        }

    def critic_prompt(self, p):
        return fill(V.CRITIC_PROMPT, paper=self.paper, id=p["id"], proposal=tight(p))

    def revision_prompt(self, p, critique):
        small = tight({"id": p["id"], "dimension": p.get("dimension"), "text": p.get("text", "")})
        return fill(V.REVISION_PROMPT, paper=self.paper, id=p["id"], dimension=p.get("dimension"), proposal=small, critique=critique)

    def meta_prompt(self, chosen):
        of = lambda rows, *names: json.dumps([{k: p[k] for k in names} for p in rows])
        return fill(
            V.META_PROMPT,
            by_dimension=json.dumps({d: [{k: p[k] for k in ("id", "text", *CRITERIA, "composite")} for p in rows] for d, rows in chosen["by_dimension"].items()}),
            strongest=of(chosen["sorted"][: self.top_k], "id", "dimension", "text", "composite"),
            unique=of(chosen["unique"][: self.top_k], "id", "dimension", "text", "uniqueness", "composite"),
            critiques=json.dumps(chosen["critiques"]),
            high_quality=of(chosen["high"], "id", "dimension", "text", *CRITERIA, "composite"),
        )

    def run(self):
        deck = [{"id": i + 1, "persona": V.DECK[i % 8][1]} for i in range(self.agents)]
        self.proposals = []
        for w in deck:
            reply = self.ask("generation", self.model, *self.generation_prompt(w))
            self.proposals.append({**reply, "id": w["id"], "persona": w["persona"]})
        self.first = self.scored(self.proposals, "scoring")
        chosen = self.select(self.first)
        high = chosen["high"]
        critiques = [{**self.ask("critique", V.GENERATION_MODEL, V.CRITIC_SYSTEM, self.critic_prompt(p)), "original_id": p["id"]} for p in high]
        heard = {c["original_id"]: c.get("critique_text", "") for c in critiques}
        revised = []
        for p in [p for p in high if p["id"] in heard][: min(self.top_k, len(high))]:
            reply = self.ask("revision", self.model, V.REVISION_SYSTEM, self.revision_prompt(p, heard[p["id"]]))
            revised.append({**reply, "id": p["id"], "persona": p.get("persona"), "original_text": p.get("text", "")})
        self.original_high = None
        if revised:
            ids = {p["id"] for p in revised}
            chosen = self.select(self.scored(revised, "re_scoring") + [p for p in high if p["id"] not in ids])
            self.original_high = high
        chosen["critiques"] = critiques
        self.selection = chosen
        self.user = self.meta_prompt(chosen)
        self.report = self.ask("meta_review", V.META_MODEL, V.META_SYSTEM, self.user, as_json=False)
        self.cost(high, heard)
        return self

    def cost(self, high, heard):
        """Tokens in and out, and dollars, by stage in order; then their sums."""
        n, rows = self.count, {}
        scores = lambda p: n(tight({k: p[k] for k in CRITERIA}))
        small = lambda p: tight({"id": p["id"], "dimension": p.get("dimension", ""), "text": p.get("text", "")})
        rows["generation"] = self.model, sum(sum(map(n, self.generation_prompt(p))) for p in self.proposals), sum(n(small(p)) for p in self.proposals)
        long = lambda p: fill(V.SCORING_PROMPT, paper=self.paper, text=p.get("text", ""), dimension=p.get("dimension", ""))
        rows["scoring"] = V.SCORING_MODEL, sum(n(V.SCORING_SYSTEM) + n(long(p)) for p in self.first), sum(map(scores, self.first))
        rows["critiques"] = self.model, sum(n(V.CRITIC_SYSTEM) + n(self.critic_prompt(p)) for p in high), sum(n(tight({"original_id": p["id"], "critique_text": heard[p["id"]]})) for p in high if p["id"] in heard)
        if self.original_high is not None:
            again = [p for p in high if heard.get(p["id"])]
            rows["revision"] = self.model, sum(n(V.REVISION_SYSTEM) + n(self.revision_prompt(p, heard[p["id"]])) for p in again), sum(n(small(p)) for p in again)
            merged = self.selection["high"]
            rows["re_scoring"] = V.SCORING_MODEL, sum(n(V.SCORING_SYSTEM) + n(self.pass_prompt(p, k)) for p in merged for k in (1, 2)), sum(2 * scores(p) for p in merged)
        rows["meta_review"] = V.META_MODEL, n(V.META_SYSTEM) + n(self.user), n(self.report)
        self.stages = {s: (m, p, c, p * (PRICES[m][0] / 1e6) + c * (PRICES[m][1] / 1e6)) for s, (m, p, c) in rows.items() if s not in ("revision", "re_scoring") or p + c}
        dollars = 0.0
        for _, _, _, usd in self.stages.values():
            dollars += usd
        self.total = sum(x[1] for x in self.stages.values()), sum(x[2] for x in self.stages.values()), dollars
