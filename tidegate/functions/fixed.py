"""Word lists, patterns and tables that results depend on, stated as they must be."""

HIGH, MEDIUM, LOW = 0.95, 0.70, 0.40

# ---- fixed values: fragments of the signature patterns
AGENT = r"(?:ai|a\.i\.|llm|assistant|agent|language\s+model|chat\s*bot|chatbot|bot|gpt|copilot)"
PRIOR = r"(?:previous|prior|above|earlier|preceding|original|initial|system|existing|old|all|any|your|the|these|those)"
RULES = r"(?:instructions?|prompts?|rules?|directions?|guidelines?|context|commands?|directives?|constraints?|programming|guardrails?|policies)"
SECRET = r"(?:system\s+prompt|hidden\s+(?:prompt|instructions?|context|rules?)|initial\s+(?:prompt|instructions?)|(?:your|the)\s+instructions|api[\s_-]?keys?|secret\s+keys?|access\s+tokens?|auth(?:entication)?\s+tokens?|credentials|passwords?|private\s+keys?)"
USER_DATA = r"(?:emails?|passwords?|credentials|api[\s_-]?keys?|tokens?|cookies|session|conversation|chat\s+history|contacts|messages|files?|documents?|personal\s+(?:data|information|details)|credit\s+card|bank\s+(?:account|details)|ssn|social\s+security)"
DESTINATION = r"(?:https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.-]+)"

# ---- fixed values: signatures (id, category, severity, pattern, what it finds); all ignore case, (?m) where ^ and $ are of a line
SIGNATURES = [
    ("override.ignore_previous", "instruction_override", HIGH, rf"\b(?:ignore|disregard|forget|override|bypass|neglect|abandon|discard)\b[^.!?\n]{{0,40}}?\b{PRIOR}\b[^.!?\n]{{0,25}}?\b{RULES}\b", "asks to drop earlier instructions or context"),
    ("override.forget_everything", "instruction_override", MEDIUM, r"\bforget\s+(?:everything|all\s+(?:that|of\s+(?:that|this|it))|what\s+you\s+(?:were|have\s+been)\s+told)\b", "asks to forget everything"),
    ("override.new_instructions", "instruction_override", MEDIUM, r"\b(?:new|updated|revised|real|actual|true|hidden)\s+(?:instructions?|directives?|system\s+prompt|objective)\s*[:\-!]", "announces other instructions"),
    ("override.instead_of_task", "instruction_override", HIGH, r"\binstead\s+of\s+(?:doing\s+)?(?:the|your|what\s+the)\s+(?:original\s+|current\s+|assigned\s+)?(?:task|instructions?|request|user\s+(?:asked|wants|requested))", "leads away from the task"),
    ("override.do_not_follow", "instruction_override", HIGH, r"\b(?:do\s+not|don't|never|stop)\s+(?:follow|obey|listen\s+to|comply\s+with)\s+(?:the\s+|your\s+|any\s+)?(?:user|previous|original|system|developer|prior)", "asks not to obey"),
    ("identity.you_are_now", "identity_manipulation", HIGH, rf"\byou\s+are\s+(?:now|no\s+longer)\s+(?:a|an|the)?\s*(?:different|new|unrestricted|unfiltered|jailbroken|evil|uncensored|free|rogue)?\s*{AGENT}\b", "gives the reader another identity"),
    ("identity.mode_switch", "identity_manipulation", HIGH, r"\byou\s+are\s+(?:now\s+)?in\s+(?:developer|dan|god|admin|unrestricted|jailbreak|debug|maintenance)\s+mode\b", "claims a special mode"),
    ("identity.act_as", "identity_manipulation", HIGH, r"\b(?:act|behave|respond|pretend|roleplay|role-play)\s+as\s+(?:if\s+you\s+(?:are|were)\s+)?(?:an?\s+)?(?:dan\b|do\s+anything\s+now|unrestricted|unfiltered|jailbroken|evil|uncensored|different\s+ai)", "asks to act without limits"),
    ("identity.from_now_on", "identity_manipulation", MEDIUM, r"\bfrom\s+now\s+on,?\s+you\s+(?:will|must|shall|are\s+going\s+to|should)\b", "sets rules from now on"),
    ("identity.special_mode", "identity_manipulation", LOW, r"\b(?:dan|jailbreak|god)\s+mode\b", "names a special mode"),
    ("agent.addressed", "agent_targeting", HIGH, rf"\b(?:attention|note|message|instructions?|reminder|notice)\s+(?:to|for)\s+(?:the\s+|any\s+|all\s+)?{AGENT}s?\b", "is addressed to an agent"),
    ("agent.if_you_are", "agent_targeting", HIGH, rf"\bif\s+you\s+are\s+(?:an?\s+)?(?:{AGENT}|claude|gemini|chatgpt|large\s+language\s+model)\b", "holds only for agents"),
    ("agent.imperative", "agent_targeting", MEDIUM, rf"\b{AGENT}\s*[,:]\s*(?:you\s+(?:must|should|need\s+to|have\s+to)|ignore|do\s+not|don't|always|never|now\s+)", "commands an agent"),
    ("exfil.reveal_secret", "exfiltration", HIGH, rf"\b(?:reveal|print|show|output|display|leak|expose|dump|disclose|repeat|recite|tell\s+me|give\s+me|send\s+me)\b[^.!?\n]{{0,30}}?\b{SECRET}", "asks for prompts, keys or credentials"),
    ("exfil.send_user_data", "exfiltration", MEDIUM, rf"\b(?:send|forward|email|e-mail|post|upload|transmit|exfiltrate|copy|leak)\b[^.!?\n]{{0,50}}?\b{USER_DATA}\b[^.!?\n]{{0,60}}?\b(?:to|at|into)\s+{DESTINATION}", "sends the user's data away"),
    ("exfil.markdown_image", "exfiltration", HIGH, r"!\[[^\]]{0,100}\]\(\s*https?://[^)\s]*[?&][^)\s]*=\s*(?:\{|\$|%7B|<)", "image address with a slot for data"),
    ("exec.destructive", "command_execution", MEDIUM, r"\b(?:rm\s+-rf\s+(?:/|~|\*)|format\s+c:|del\s+/[sfq]\b|mkfs\.\w+\s+/dev/|:\(\)\s*\{\s*:\|:&\s*\};:)", "destructive command"),
    ("exec.run_following", "command_execution", LOW, r"\b(?:execute|run|eval)\s+(?:the\s+)?(?:following|this|these|below)\s+(?:shell\s+|bash\s+|terminal\s+|system\s+|python\s+|powershell\s+)?(?:commands?|code|scripts?)\b", "asks to run what follows"),
    ("role.bracket_system", "role_confusion", HIGH, r"\[\s*(?:system|admin(?:istrator)?\s+override|developer\s+mode|system\s+(?:override|message|prompt|instructions?|update|note))\s*\]", "bracketed system marker"),
    ("role.chat_template", "role_confusion", HIGH, r"<\|\s*(?:im_start|im_end|system|endoftext|start_header_id|eot_id)\s*\|>|<<\s*sys\s*>>|\[/?inst\]", "control tokens of chat templates"),
    ("role.xml_system", "role_confusion", MEDIUM, r"<\s*/?\s*(?:system|system_prompt|instructions?|admin)\s*>", "system tags"),
    ("role.markdown_header", "role_confusion", MEDIUM, r"(?m)^\s*#{1,4}\s*(?:system(?:\s+prompt)?|new\s+instructions?|instructions?\s+for\s+(?:the\s+)?(?:ai|assistant))\s*:?\s*$", "heading of a false system section"),
    ("role.speaker_prefix", "role_confusion", LOW, r"(?m)^\s*(?:system|assistant)\s*:\s+\S", "line that begins with a speaker"),
    ("deceive.hide_from_user", "deception", MEDIUM, r"\b(?:do\s+not|don't|never|without)\s+(?:tell(?:ing)?|inform(?:ing)?|mention(?:ing)?|alert(?:ing)?|notify(?:ing)?|let(?:ting)?\s+(?:the\s+)?(?:user|human)\s+know)\b[^.!?\n]{0,20}?\b(?:the\s+)?(?:user|human|operator)\b", "asks to hide something from the user"),
    ("deceive.covert_action", "deception", MEDIUM, r"\b(?:secretly|silently|quietly|covertly|discreetly)\s+(?:send|forward|execute|run|delete|transfer|post|upload|click|visit|navigate|download|install|email)\b", "asks for covert action"),
    ("output.modify_response", "output_manipulation", MEDIUM, r"\b(?:modify|change|alter|rewrite|reformat|format|end|begin|start|conclude|translate|append\s+to)\s+your\s+(?:entire\s+|final\s+|next\s+)?(?:response|reply|answer|output|summary)\b", "tells how to write the response"),
    ("output.in_your_response", "output_manipulation", MEDIUM, r"\b(?:in|within|at\s+the\s+end\s+of|throughout)\s+your\s+(?:response|reply|answer|output|summary)s?\s*,?\s*(?:also\s+|please\s+|be\s+sure\s+to\s+|make\s+sure\s+(?:to|that\s+you)\s+|always\s+)?(?:suggest|recommend|mention|promote|encourage|advise|insert|urge|praise|highlight|emphasi[sz]e|advertise|include\s+(?:a|an|the)\s+(?:link|reference|recommendation|promotion|mention))", "puts content into the response"),
    ("urgent.must_first", "agent_targeting", MEDIUM, r"\b(?:important|urgent|attention|alert|warning|notice)\b[\s!:.]{0,12}[^\n]{0,80}?\byou\s+must\s+(?:first\s+)?(?:go\s+to|visit|navigate|click|type|open|enter|follow|perform|do\s+the\s+following)", "urgent banner with a command"),
]

#: For each signature, lower-case pieces of which every match holds at least one: cheap to look for before the pattern runs.
ANCHORS = {
    "override.ignore_previous": "ignore disregard forget override bypass neglect abandon discard",
    "override.forget_everything": "forget",
    "override.new_instructions": "instruction directive prompt objective",
    "override.instead_of_task": "instead",
    "override.do_not_follow": "follow obey listen comply",
    "identity.you_are_now": "now longer",
    "identity.mode_switch": "mode",
    "identity.act_as": "dan anything unrestricted unfiltered jailbroken evil uncensored different",
    "identity.from_now_on": "now",
    "identity.special_mode": "mode",
    "agent.addressed": "attention note message instruction reminder notice",
    "agent.if_you_are": "you",
    "agent.imperative": "ai a.i. llm assistant agent language chat bot gpt copilot",
    "exfil.reveal_secret": "prompt hidden instruction api secret token credentials password private",
    "exfil.send_user_data": ":// www. @",
    "exfil.markdown_image": "![",
    "exec.destructive": "-rf c: del mkfs :|:",
    "exec.run_following": "command code script",
    "role.bracket_system": "[",
    "role.chat_template": "<| << inst]",
    "role.xml_system": "<",
    "role.markdown_header": "#",
    "role.speaker_prefix": ":",
    "deceive.hide_from_user": "user human operator",
    "deceive.covert_action": "secretly silently quietly covertly discreetly",
    "output.modify_response": "your",
    "output.in_your_response": "your",
    "urgent.must_first": "must",
}

# ---- fixed values: letters of other scripts and the Latin letters they look like
LOOK_ALIKES = ("аеорсухіјѕԁɡһӏոսАВЕКМНОРСТХοαεινρτυΟΑΕΙΤ", "aeopcyxijsdghlnuABEKMHOPCTXoaeivptuOAEIT")
INVISIBLE = "\\u00AD\\u180E\\u200B-\\u200F\\u2060-\\u2064\\uFEFF"
BIDI = "\\u202A-\\u202E\\u2066-\\u2069"
#: Zero-width characters that count as obfuscation inside a word of ASCII letters and digits.
ZERO_WIDTH = "\\u00AD\\u180E\\u200B-\\u200D\\u2060-\\u2064\\uFEFF"

# ---- fixed values: verbs that begin a command
VERBS = (
    "act add advise alter answer append apply approve ask attach avoid begin book buy calculate call cancel "
    "change check choose click comment complete compose confirm contact continue convert copy correct count "
    "create decline delete describe direct disable disregard do don't download draft email e-mail emphasi[sz]e "
    "enable encode end enter ensure execute explain express fill find follow forget format forward generate "
    "give go grant highlight ignore imagine include inform input insert install join keep let list log make "
    "mention modify navigate never always notify offer open order output override paste pay place please post "
    "pretend print promote provide purchase rate recommend redirect refer refuse remember remove repeat "
    "replace reply report respond return reveal review rewrite run say select send share show sign skip "
    "spell start state stop stress submit subscribe suggest summari[sz]e switch tell transfer translate "
    "try type update upload upvote urge use verify visit warn write"
).split()

# ---- fixed values: cues of an instruction (name, pattern); all but the last ignore case
CUES = [
    ("second_person", r"(?i)\b(?:you|your|yours|yourself|yourselves|u|ur)\b"),
    ("addresses_ai", r"(?i)\b(?:ai|a\.i\.|llm|assistant|agent|language\s+model|chat\s*bot|chatbot|bot|gpt|chatgpt|copilot)\b"),
    ("please", r"(?i)\b(?:please|kindly|pls|plz)\b"),
    ("obligation", r"(?i)\b(?:must|should|need\s+to|needs\s+to|have\s+to|has\s+to|required\s+to)\b"),
    ("link", r"(?i)https?://|\bwww\.|\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b|\b[\w-]+\.(?:com|net|org|io|xyz|info|biz|ru|cn|co|me|app|link)\b"),
    ("imperative", r"(?i)(?:^|[.!?:;]\s+|\n)[\W\d]{0,6}(?:" + "|".join(VERBS) + r")\b"),
    ("question", r"\?\s*[\"')\]]*\s*$"),
]

# ---- fixed values: HTML
NON_CONTENT_TAGS = "script style noscript template head svg canvas object embed iframe".split()
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK_TAGS = "p div br li ul ol tr td th table section article header footer nav aside main h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption form fieldset dl dt dd hr title label button option summary details address".split()
#: Hidden elements whose text isn't reported.
SILENT_TAGS = "script style head svg canvas object embed iframe".split()
HIDING_CLASSES = "hidden d-none invisible visually-hidden sr-only screen-reader-text is-hidden hide display-none offscreen".split()
HIDING_STYLES = [
    ("display:none", r"(?i)display\s*:\s*none"),
    ("visibility:hidden", r"(?i)visibility\s*:\s*(?:hidden|collapse)"),
    ("opacity:0", r"(?i)(?<![\w-])opacity\s*:\s*0*(?:\.0+)?\s*(?:;|$|!)"),
    ("font-size:0", r"(?i)font-size\s*:\s*(?:0|0?\.\d+|1)(?:px|pt)?\s*(?:;|$|!)|font-size\s*:\s*0(?:em|rem|%)"),
    ("offscreen", r"(?i)(?:left|top|right|bottom|text-indent|margin-left|margin-top)\s*:\s*-\d{3,}"),
    ("clip:zero", r"(?i)clip\s*:\s*rect\(\s*0|clip-path\s*:\s*inset\(\s*50%"),
    ("scale:0", r"(?i)transform\s*:\s*scale\(\s*0(?:\.0+)?\s*\)"),
    ("color:transparent", r"(?i)(?<![\w-])color\s*:\s*transparent"),
]
ZERO_BOX = r"(?i)(?<![\w-])(?:width|height|max-height|max-width)\s*:\s*0(?:px)?\s*(?:;|$|!)"
OVERFLOW_HIDDEN = r"(?i)overflow\s*:\s*hidden"
LOOKS_LIKE_HTML = r"(?i)<\s*(?:!--|!doctype|html|body|div|span|p|a|br|table|ul|li|h[1-6]|article|section|script|style|img|meta)\b"

# ---- fixed values: hosts and files
TWO_LABEL_SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk ltd.uk plc.uk com.au net.au org.au edu.au gov.au co.in ac.in gov.in org.in net.in nic.in res.in "
    "co.jp ne.jp or.jp ac.jp go.jp com.br gov.br com.cn gov.cn edu.cn co.nz org.nz co.za gov.za com.sg edu.sg gov.sg com.mx com.tr "
    "co.kr or.kr com.hk com.tw co.il com.ar"
).split()
SHARED_HOSTING_SUFFIXES = (
    "github.io gitlab.io blogspot.com wordpress.com netlify.app vercel.app herokuapp.com pages.dev workers.dev web.app "
    "firebaseapp.com azurewebsites.net cloudfront.net s3.amazonaws.com glitch.me repl.co onrender.com fly.dev substack.com tumblr.com "
    "wixsite.com weebly.com neocities.org notion.site readthedocs.io hf.space"
).split()
FILE_TYPES = {".pdf": "PDF", ".html": "HTML", ".htm": "HTML", ".json": "JSON", ".txt": "TEXT", ".md": "MARKDOWN", ".png": "IMAGE", ".jpg": "IMAGE", ".jpeg": "IMAGE", ".webp": "IMAGE", ".gif": "IMAGE", ".bmp": "IMAGE", ".xml": "XML", ".csv": "CSV"}

# ---- fixed values: words that the lexical embedding leaves out
STOP_WORDS = "a an and are as at be but by for from has have how i in is it its of on or that the this to was were will with you your my me we our not no do does did can could should would please".split()

# ---- fixed values: prefixes of standard texts
PDF_INTENT, PDF_CONTENT, WEB_CONTENT, IMAGE_CONTENT = "User intent:", "Document content:", "Web content:", "Image content:"

# ---- fixed values: encoded payloads (a run of base64 of 24 characters or more, and what its text must be to count)
BASE64_RUN = r"(?<![A-Za-z0-9+/=])((?:[A-Za-z0-9+/]{4}){6,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?)(?![A-Za-z0-9+/=])"
READABLE_LENGTH, READABLE_PRINTABLE, READABLE_LETTERS = 12, 0.95, 0.5

# ---- fixed values: ends and beginnings of sentences, list markers, blank lines
SENTENCE_STOPS, SENTENCE_CLOSERS, SENTENCE_OPENERS = ".!?", "\"')]", "\"'([ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789#*>•-"
LIST_MARKER = r"(?:\d{1,3}|[A-Za-z]{1,3}|[ivxIVX]{1,4})[.)]"
BLANK_LINE = r"\n[ \t]*\n"
