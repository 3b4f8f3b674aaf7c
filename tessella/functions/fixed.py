"""Texts, word lists, limits and patterns that results depend on."""

# Instructions put before queries and into rerank prompts.
QUERY_INSTRUCTION = "Instruct: Given a coding task description, retrieve the most relevant skill document that would help an agent complete the task\nQuery:"
RERANK_INSTRUCTION = "Given a coding task description, judge whether the skill document is relevant and useful for completing the task"

# Words that don't identify an artifact.
ARTIFACT_STOP_WORDS = (
    "analysis and are as be by code configuration configurations content data details document documents documentation error errors file files "
    "for from in information input inputs into is item items list lists message messages object objects of on or output outputs plan plans project "
    "projects report reports request requests response responses result results system task tasks test testing tests text the to user users value "
    "values with"
).split()
# Action words of steps that make something, and of steps that use it.
PRODUCER_ACTIONS = "build collect compile convert create derive extract fetch generate implement produce transform write".split()
CONSUMER_ACTIONS = "analyze analyse audit compare deploy evaluate integrate publish render review summarize test validate verify visualize".split()

# Fields with gold ids, in the order in which the first list wins, and those that name benchmark documents.
GOLD_FIELDS = ("core_gt_ids", "core_gold_skill_ids", "gt_skill_ids", "gold_skill_ids")
BENCHMARK_ID_FIELDS = (*GOLD_FIELDS, "auxiliary_gt_ids", "auxiliary_gold_skill_ids", "all_gold_skill_ids")

# Limits of contract collections: most items, base share and order of filling up, in the collections' order.
CONTRACT_LIMITS = {"operations": 12, "inputs": 8, "outputs": 10, "preconditions": 8, "constraints": 12, "dependencies": 8, "exclusions": 8, "quality_criteria": 8}
CONTRACT_BASE = {"operations": 8, "inputs": 4, "outputs": 5, "preconditions": 2, "constraints": 5, "dependencies": 4, "exclusions": 2, "quality_criteria": 2}
CONTRACT_FILL = ("operations", "outputs", "constraints", "quality_criteria", "inputs", "dependencies", "preconditions", "exclusions")
CONTRACT_TOTAL = 32
DESCRIPTION_CHARS, BODY_CHARS = 2000, 20000

# Patterns that classify evidence and statements (case is ignored).
TRIGGER = (
    r"\b(?:this\s+skill\s+)?(?:should\s+be\s+used|is\s+used|activates?|triggers?)\s+when\b"
    r"|\buse\s+(?:this\s+)?skill\s+when\b"
    r"|\bwhen\s+(?:the\s+)?user\s+(?:asks?|requests?|mentions?)\b"
    r"|\bdo\s+not\s+invoke\b"
    r"|\balready\s+(?:ran|run|invoked|used)\b"
    r"|\bcuando\s+(?:el\s+)?usuario\s+(?:pregunta|pide|solicita|menciona)\b"
    r"|当用户.*(?:询问|要求|请求|提到)"
    r"|ユーザーが.*(?:場合|とき)"
    r"|사용자가.*(?:요청|질문|언급).*(?:할\s*때|하면)"
)
EXPLICIT_EXCLUSION = (
    r"\b(?:out[- ]of[- ]scope|non[- ]goals?|excluded?|unsupported|not\s+supported|"
    r"does\s+not\s+(?:cover|include|provide|handle|support)|do\s+not\s+(?:cover|include|support)|"
    r"must\s+not|never|cannot|can't|without)\b"
    r"|对象外|対象外|不支持|不包含|不提供|不负责|禁止|不允许|不能|不会"
    r"|지원하지|포함하지|제외|금지"
    r"|\b(?:fuera\s+de\s+alcance|no\s+(?:admite|incluye|proporciona))\b"
)
EXCLUSION_HEADING = (
    r"\b(?:out[- ]of[- ]scope|non[- ]goals?|exclusions?|unsupported|not\s+supported)\b"
    r"|对象外|対象外|非目标|范围外|不支持|제외|지원하지"
    r"|\bfuera\s+de\s+alcance\b"
)
CONDITIONAL_CONFIGURATION = (
    r"(?:\B--[a-z0-9][a-z0-9-]*.*\b(?:exclude|excluded|disable|disabled|enable|enabled)\b)"
    r"|(?:\b(?:exclude|excluded|disable|disabled|enable|enabled)\b.*\B--[a-z0-9][a-z0-9-]*)"
    r"|(?:\bdefault(?:s)?\b.{0,24}\b(?:excluded|disabled)\b)"
    r"|(?:\bunless\b.{0,80}\b(?:flag|option|enabled)\b)"
)
REQUEST_PRECONDITION = (
    r"^\s*(?:the\s+)?user\s+(?:must\s+)?(?:asks?|requests?|wants?|needs?|provides?|"
    r"has\s+(?:a|an)\s+(?:project|task|request|feature|problem|goal))\b"
)
SYMPTOM_PRECONDITION = r"\b(?:feels?|looks?|seems?|behaves?)\s+(?:wrong|off|bad|incorrect)\b"
WORKFLOW_PRECONDITION = r"\bmust\s+(?:be\s+)?(?:created|performed|run|read|checked|verified|searched)\b"
# Words that a statement is compared without, and word forms that count as one.
STATEMENT_STOP = "must|should|shall|the|a|an|be|is|are|was|were|to"
STATEMENT_FORMS = {"has": "have", "compiles": "compile", "handles": "handle", "included": "include"}
# Words that call something by a label, and those that may stand between such a word and the label.
LABEL_KINDS = ("skill", "plugin", "agent", "tool")
LABEL_CALLS = ("label", "named", "called")
# What a dependency may be, and the states of a finished extraction.
DEPENDENCY_TYPES = ("software", "service", "hardware", "knowledge", "data", "other")
EXTRACTION_STATUSES = ("validated", "needs_review")
