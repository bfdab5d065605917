"""The rule catalogue, and how rules become Spark columns.

A rule pairs a pattern (ECMAScript dialect) with a *gate*: text every match
must contain.  The scan tests the gate with ``contains`` and runs the regex on
the rows that pass, which for most rules is next to none of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from leakscan.functions import ecmascript, regex
from leakscan.functions.text import JS_SPACE_CLASS, is_blank

OPEN, CLOSE = "\ue000", "\ue001"  # not in texts that are searched; the first marks both ends of a match


# Punctuation rare enough in prose to be worth looking for first, rarest first.
ANCHORS = "_=@:-"


@dataclass(frozen=True)
class Gate:
    """What a text must contain for a rule to have a chance.

    Every group needs one of its needles; ``low`` groups ignore case;
    ``pattern`` is a looser regex than the rule's.  ``lead`` gives the first
    character of a match and, as a regex, what follows it.
    """

    exact: tuple[tuple[str, ...], ...] = ()
    low: tuple[tuple[str, ...], ...] = ()
    pattern: str | None = None
    lead: tuple[str, str] | None = None

    @property
    def anchor(self) -> str | None:
        """A character of ``ANCHORS`` the gate cannot hold without."""
        for char in ANCHORS:
            if any(all(char in needle for needle in group) for group in self.exact + self.low):
                return char
        return None

    @property
    def screen(self) -> str | None:
        """The name of the screen in front of this gate, if there is one."""
        return self.anchor or ("lead" if self.lead else None)

    def column(self, text: Column, lowered: Column) -> Column:
        tests = [_any_of(text, group) for group in self.exact]
        tests += [_any_of(lowered, group) for group in self.low]
        if self.pattern:
            tests.append(text.rlike(self.pattern))
        # Only unrestricted custom patterns come without a test of their own.
        test = tests[0] if tests else ~is_blank(text)
        for other in tests[1:]:
            test = test & other
        return test


NO_GATE = Gate()


def screens(text: Column, rules: Iterable[Rule]) -> dict[str, Column]:
    """Cheap tests that each stand in front of several gates.

    The needles of all gates together are dozens, and looking for one reads the
    text once.  Most texts lack the single characters most needles contain, and
    a single regex rules out the needles without any.
    """
    gates = dict.fromkeys(rule.gate for rule in rules)
    tests = {g.anchor: text.contains(g.anchor) for g in gates if g.anchor}
    leads: dict[str, list[str]] = {}
    for gate in gates:
        if gate.screen == "lead":
            leads.setdefault(gate.lead[0], []).append(gate.lead[1])
    if leads:
        # The class settles most positions with one table lookup.
        first = "".join(leads)
        branches = "|".join(f"[{char}](?={'|'.join(rest)})" for char, rest in leads.items())
        tests["lead"] = text.rlike(f"[{first}](?<={branches})")
    return tests


def _any_of(text: Column, needles: tuple[str, ...]) -> Column:
    if len(needles) == 1:
        return text.contains(needles[0])
    return text.rlike("|".join(regex.quote(needle) for needle in needles))


@dataclass(frozen=True)
class Rule:
    id: str
    label: str
    category: str
    base: int
    pattern: str
    flags: str
    explanation: str
    placeholder: str
    keywords: tuple[str, ...] = ()
    captures: bool = False
    gate: Gate = NO_GATE
    source: str = "builtin"
    java: str | None = None  # of a user pattern, as checked

    def marked(self, text: Column) -> Column:
        """``text`` with every match put between two marks, the same on both sides: one character is split at without a regex."""
        first = FIRST.get(self.id) if self.source == "builtin" else None
        first = f"(?={first})" if first else ""
        if self.source == "builtin" and self.id in ONE_PASS:
            java = "({})({})({})".format(*ONE_PASS[self.id])
        elif self.captures:
            before, group, after = regex.split_capture(self.pattern)
            java = regex.to_java(f"{first}({before})({group})({after})", self.flags)
        else:
            java = self.java or regex.to_java(f"{first}{self.pattern}", self.flags)
            return F.regexp_replace(text, java, f"{OPEN}$0{OPEN}")
        return F.regexp_replace(text, java, f"$1{OPEN}$2{OPEN}$3")

    def pieces(self, text: Column, lowered: Column, safe: Column, screen: Column) -> Column:
        """Gaps and matches in turn, or null where screen or gate rule them out.

        ``safe`` is ``text`` free of the two mark characters.
        """
        cut = F.split(self.marked(safe), OPEN, -1)
        return F.when(screen & self.gate.column(text, lowered), cut)


# The environment variables whose value is a secret.
ENV_NAMES = (
    r"OPENAI_API_KEY|AWS_SECRET_ACCESS_KEY|GITHUB_TOKEN|GITLAB_TOKEN|GITLAB_PAT|GITLAB_PRIVATE_TOKEN"
    r"|SLACK_BOT_TOKEN|STRIPE_SECRET_KEY|SENDGRID_API_KEY|TWILIO_AUTH_TOKEN|TWILIO_API_SECRET|TWILIO_API_KEY"
    r"|TWILIO_ACCOUNT_SID|FIREBASE_API_KEY|AZURE_CLIENT_SECRET|AZURE_STORAGE_ACCOUNT_KEY"
    r"|AZURE_STORAGE_CONNECTION_STRING|AZURE_SERVICEBUS_CONNECTION_STRING|API_KEY|SECRET_KEY|ACCESS_TOKEN"
    r"|AUTH_TOKEN|CLIENT_SECRET"
)

# --- Fixed values: the built-in rules, in tie-break order -------------------
# Fields: id, label, category, base confidence, pattern, flags, explanation,
# placeholder, context keywords, whether group 1 is reported, gate.

BUILTIN_RULES: tuple[Rule, ...] = (
    Rule(
        "openai-key", "OpenAI-style API key", "secret", 84,
        r"\bsk-(?:proj-|live-|test-)?[A-Za-z0-9_-]{20,}\b", "g",
        "This matches the prefix and length pattern used by OpenAI-style API keys.",
        "<OPENAI_API_KEY>",
        ("openai", "api_key", "authorization", "bearer", "secret", "token"),
        gate=Gate(exact=(("sk-",),)),
    ),
    Rule(
        "aws-access-key", "AWS access key", "secret", 86,
        r"\b(?:AKIA|ASIA|AIDA|AGPA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{16}\b", "g",
        "This looks like an AWS access key identifier.",
        "<AWS_ACCESS_KEY_ID>",
        ("aws", "access_key", "credentials", "iam", "secret", "token"),
        gate=Gate(
            exact=(("AKIA", "ASIA", "AIDA", "AGPA", "AROA", "AIPA", "ANPA", "ANVA"),),
            lead=("A", "KIA|SIA|IDA|GPA|ROA|IPA|NPA|NVA"),
        ),
    ),
    Rule(
        "github-token", "GitHub token", "secret", 88,
        r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b", "g",
        "This matches the known prefixes used by GitHub personal, OAuth, or installation tokens.",
        "<GITHUB_TOKEN>",
        ("github", "token", "pat", "auth", "header"),
        gate=Gate(exact=(("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),)),
    ),
    Rule(
        "gitlab-token", "GitLab token", "secret", 88,
        r"\bglpat-[A-Za-z0-9_-]{20,}\b", "g",
        "GitLab personal access tokens often start with glpat- followed by a long token body.",
        "<GITLAB_TOKEN>",
        ("gitlab", "glpat", "token", "pat", "private token"),
        gate=Gate(exact=(("glpat-",),)),
    ),
    Rule(
        "sendgrid-api-key", "SendGrid API key", "secret", 92,
        r"\bSG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}\b", "g",
        "SendGrid API keys often use the SG.<prefix>.<secret> token format.",
        "<SENDGRID_API_KEY>",
        ("sendgrid", "sg.", "api key", "token"),
        gate=Gate(exact=(("SG.",),), lead=("S", r"G\.")),
    ),
    Rule(
        "twilio-account-sid", "Twilio Account SID", "secret", 64,
        r"\bAC[A-Za-z0-9]{32}\b", "g",
        "Twilio Account SIDs are 34-character identifiers starting with AC.",
        "<TWILIO_ACCOUNT_SID>",
        ("twilio", "account sid", "twilio account"),
        gate=Gate(exact=(("AC",),), lead=("A", "C[A-Za-z0-9]{32}")),
    ),
    Rule(
        "twilio-api-key-sid", "Twilio API Key SID", "secret", 64,
        r"\bSK[A-Za-z0-9]{32}\b", "g",
        "Twilio API Key SIDs are 34-character identifiers starting with SK.",
        "<TWILIO_API_KEY_SID>",
        ("twilio", "api key", "key sid", "twilio key"),
        gate=Gate(exact=(("SK",),), lead=("S", "K[A-Za-z0-9]{32}")),
    ),
    Rule(
        "twilio-auth-token", "Twilio auth token", "secret", 90,
        r"""\b(?:TWILIO_AUTH_TOKEN|TWILIO_API_SECRET)\s*[:=]\s*["']?([A-Fa-f0-9]{32})["']?""", "gi",
        "This looks like a Twilio auth token (or API secret) assigned in a configuration line.",
        "<TWILIO_AUTH_TOKEN>",
        ("twilio", "auth token", "api secret", "token"),
        captures=True, gate=Gate(low=(("twilio_auth_token", "twilio_api_secret"),)),
    ),
    Rule(
        "slack-token", "Slack token", "secret", 88,
        r"\bxox(?:a|b|o|p|r|s)-[A-Za-z0-9-]{10,}\b", "g",
        "Slack tokens typically start with xox followed by a token class prefix.",
        "<SLACK_TOKEN>",
        ("slack", "bot", "workspace", "token"),
        gate=Gate(exact=(("xox",),)),
    ),
    Rule(
        "stripe-secret-key", "Stripe secret key", "secret", 88,
        r"\bsk_(?:live|test)_[0-9A-Za-z]{16,}\b", "g",
        "Stripe secret keys use a stable sk_live or sk_test prefix.",
        "<STRIPE_SECRET_KEY>",
        ("stripe", "secret", "payment", "api"),
        gate=Gate(exact=(("sk_live_", "sk_test_"),)),
    ),
    Rule(
        "google-api-key", "Google API key", "secret", 86,
        r"\bAIza[0-9A-Za-z\-_]{35}\b", "g",
        "Google API keys typically begin with AIza followed by a fixed-length token body.",
        "<GOOGLE_API_KEY>",
        ("google", "gcp", "maps", "api"),
        gate=Gate(exact=(("AIza",),), lead=("A", "Iza")),
    ),
    Rule(
        "firebase-api-key", "Firebase API key", "secret", 82,
        r"\bAIza[0-9A-Za-z\-_]{35}\b", "g",
        "Firebase client-side configs often include a Google-style API key; treat it as sensitive in prompts.",
        "<FIREBASE_API_KEY>",
        ("firebase", "apikey", "api key", "config", "google"),
        gate=Gate(exact=(("AIza",),), lead=("A", "Iza")),
    ),
    Rule(
        "gcp-service-account-private-key-id", "GCP service account private_key_id", "secret", 86,
        r'"private_key_id"\s*:\s*"([A-Fa-f0-9]{20,})"', "g",
        "This looks like the private_key_id field from a Google Cloud service account JSON key.",
        "<GCP_SERVICE_ACCOUNT_PRIVATE_KEY_ID>",
        ("service_account", "private_key_id", "gcp", "google", "credential"),
        captures=True, gate=Gate(exact=(('"private_key_id"',),)),
    ),
    Rule(
        "gcp-service-account-client-email", "GCP service account client_email", "secret", 82,
        r'"client_email"\s*:\s*"([^"\s]+@[^"\s]+\.gserviceaccount\.com)"', "gi",
        "This looks like the client_email field from a Google Cloud service account JSON key.",
        "<GCP_SERVICE_ACCOUNT_EMAIL>",
        ("service_account", "client_email", "gcp", "google", "credential", "firebase"),
        captures=True, gate=Gate(exact=(("@",),), low=((".gserviceaccount.com",),)),
    ),
    Rule(
        "jwt", "JWT token", "secret", 82,
        r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "g",
        "The three-part dot-separated structure matches a JSON Web Token.",
        "<JWT_TOKEN>",
        ("jwt", "bearer", "authorization", "token", "session"),
        gate=Gate(exact=(("eyJ",),)),
    ),
    Rule(
        "pem-private-key", "Private key block", "secret", 99,
        r"-----BEGIN(?: RSA| EC| DSA| OPENSSH)? PRIVATE KEY-----[\s\S]+?"
        r"-----END(?: RSA| EC| DSA| OPENSSH)? PRIVATE KEY-----", "g",
        "This is a full private key block and should never be shared in a prompt.",
        "<PRIVATE_KEY_BLOCK>",
        ("private key", "ssh", "pem", "rsa"),
        gate=Gate(exact=(("-----BEGIN",), ("-----END",))),
    ),
    Rule(
        "bearer-token", "Bearer token", "secret", 86,
        r"\bBearer\s+([A-Za-z0-9._~+/=-]{16,})\b", "gi",
        "A bearer authorization header usually contains a live credential value after the scheme.",
        "<BEARER_TOKEN>",
        ("bearer", "authorization", "header", "auth"),
        captures=True, gate=Gate(low=(("bearer",),), lead=("bB", "(?i:earer)")),
    ),
    Rule(
        "auth-header", "Authorization header credential", "secret", 89,
        r"\bAuthorization\s*:\s*(?:Bearer|Basic)\s+([A-Za-z0-9._~+/=-]{16,})\b", "gi",
        "This captures the credential portion of an HTTP Authorization header.",
        "<AUTH_CREDENTIAL>",
        ("authorization", "header", "basic", "bearer", "auth"),
        captures=True, gate=Gate(exact=((":",),), low=(("authorization",),)),
    ),
    Rule(
        "env-assignment", "Secret environment variable value", "secret", 92,
        r"(?:^|[\r\n])\s*(?:" + ENV_NAMES + r""")\s*=\s*["']?([^"'\r\n\s]+)["']?""", "gim",
        "This looks like a real secret value assigned inside an .env-style configuration line.",
        "<ENV_SECRET>",
        ("api_key", "secret_key", "token", "client_secret", "env"),
        captures=True,
        gate=Gate(exact=(("=",),), low=(("_key", "_token", "_pat", "_secret", "_sid", "_string"),)),
    ),
    Rule(
        "connection-string-password", "Connection string password", "secret", 91,
        r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp):\/\/[^\s:@/]+:([^@\s]+)@", "gi",
        "A database or queue connection string contains an embedded password value.",
        "<CONNECTION_PASSWORD>",
        ("database", "connection string", "password", "postgres", "mongodb", "mysql"),
        captures=True,
        gate=Gate(exact=(("://",), ("@",)), low=(("postgres", "mysql", "mongodb", "redis", "amqp"),)),
    ),
    Rule(
        "azure-storage-connection-string-key", "Azure Storage connection string key", "secret", 92,
        r"\bDefaultEndpointsProtocol=https;AccountName=[^;\s]+;AccountKey=([^;\s]+)"
        r";EndpointSuffix=core\.windows\.net\b", "gi",
        "Azure Storage connection strings embed an AccountKey credential value.",
        "<AZURE_STORAGE_ACCOUNT_KEY>",
        ("azure", "storage", "accountkey", "connection string", "blob"),
        captures=True, gate=Gate(exact=(("=",),), low=(("accountkey=",),)),
    ),
    Rule(
        "azure-servicebus-connection-string-key", "Azure Service Bus connection string key", "secret", 92,
        r"\bEndpoint=sb://[^;\s]+;SharedAccessKeyName=[^;\s]+;SharedAccessKey=([^;\s]+)", "gi",
        "Azure Service Bus connection strings embed a SharedAccessKey credential value.",
        "<AZURE_SERVICEBUS_SHARED_ACCESS_KEY>",
        ("azure", "service bus", "sharedaccesskey", "connection string", "sb://"),
        captures=True, gate=Gate(exact=(("=",),), low=(("sharedaccesskey=",),)),
    ),
    Rule(
        "azure-sas-token-sig", "Azure SAS token signature", "secret", 86,
        r"\bsv=\d{4}-\d{2}-\d{2}[^\s]*?(?:\?|&)sig=([^&\s]+)", "gi",
        "Azure SAS URLs include a sig= parameter that functions like a credential.",
        "<AZURE_SAS_SIGNATURE>",
        ("azure", "sas", "sig=", "storage", "blob"),
        captures=True, gate=Gate(exact=(("=",),), low=(("sig=",), ("sv=",))),
    ),
    Rule(
        "kv-secret-value", "Structured secret value", "secret", 70,
        r"(?:^|[;\s])(?:password|pwd|client_secret|secret|token)\s*=\s*([^;\s]+)", "gim",
        "This looks like a credential value in a key-value configuration string.",
        "<SECRET_VALUE>",
        ("password", "secret", "token", "client_secret", "config"),
        captures=True, gate=Gate(exact=(("=",),), low=(("password", "pwd", "secret", "token"),)),
    ),
    Rule(
        "email", "Email address", "pii", 76,
        r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "gi",
        "This appears to be a real email address and may identify a person or account.",
        "<EMAIL_ADDRESS>",
        ("email", "mail", "contact", "user"),
        gate=Gate(exact=(("@",),)),
    ),
    Rule(
        "phone", "Phone number", "pii", 68,
        r"(?<!\w)(?:\+?\d{1,3}[\s().-]*)?(?:\d[\s().-]*){9,14}\d(?!\w)", "g",
        "This number looks like a phone number and may expose personal contact details.",
        "<PHONE_NUMBER>",
        ("phone", "mobile", "sms", "contact", "call"),
        # Ten digits, spelled out: quicker than a counted group.
        gate=Gate(pattern=rf"\d[{JS_SPACE_CLASS}().-]*" * 9 + r"\d"),
    ),
)

_SPACE = f"[{JS_SPACE_CLASS}]"
_BLANK = r"[\t\x0B\f \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\ufeff]"

# Two patterns, tried at every position as they stand, search a run of text again
# from each of its positions: a page with much blank space or a long encoded
# string would take time quadratic in it.  These find the same matches (before,
# reported, after) in one pass, in Java syntax:
# - of the line starts a run of white space has before a variable, the last one
#   does, and only blanks can follow it;
# - an address starts at the first word character of its run, or, right behind
#   another address, at once; no later start in the run can do better.
ONE_PASS = {
    "env-assignment": (
        rf"(?im)(?:\A|(?<=[\n\r\u2028\u2029])){_BLANK}*+(?:{ENV_NAMES}){_SPACE}*+={_SPACE}*+[\"']?",
        rf"[^\"'{JS_SPACE_CLASS}]+",
        r"[\"']?",
    ),
    "email": (
        r"(?:\G(?<=\w)(?=[.%+-])|(?<![\w.%+-])[.%+-]*+(?=\w))",
        r"[\w.%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))",
        "",
    ),
}

# What every match begins with, looked for before the word edge in front of it, which costs more to test.
FIRST = {
    "openai-key": "sk-", "aws-access-key": "A", "github-token": "g", "gitlab-token": "glpat-", "sendgrid-api-key": "SG",
    "twilio-account-sid": "AC", "twilio-api-key-sid": "SK", "twilio-auth-token": "TWILIO_A", "slack-token": "xox",
    "stripe-secret-key": "sk_", "google-api-key": "AIza", "firebase-api-key": "AIza", "jwt": "eyJ", "bearer-token": "Bearer",
    "auth-header": "Authorization", "connection-string-password": "[pmra]", "azure-storage-connection-string-key": "Default",
    "azure-servicebus-connection-string-key": "Endpoint=", "azure-sas-token-sig": "sv=", "kv-secret-value": r"\W?[pcst][awleo]",
    "phone": r"[+\d]",
}

# Confidence before context, for rules a user supplies.
CUSTOM_BASE = {"secret": 82, "pii": 72}

# The rule pack offered to new users.
STARTER_PACK = {
    "name": "Engineering Demo Pack",
    "description": "Sample company-style token formats for staging, internal demos, and sandbox credentials.",
    "patterns": [
        {
            "label": "Demo service token",
            "pattern": r"\bdemo_[A-Za-z0-9]{18,}\b",
            "flags": "g",
            "category": "secret",
            "explanation": "Matches long demo service tokens that still should not be pasted into public LLM tools.",
            "placeholder": "<DEMO_SERVICE_TOKEN>",
        },
        {
            "label": "Sandbox access token",
            "pattern": r"\bsbx_[A-Za-z0-9_-]{20,}\b",
            "flags": "g",
            "category": "secret",
            "explanation": "Captures sandbox API tokens often shared during internal development.",
            "placeholder": "<SANDBOX_ACCESS_TOKEN>",
        },
        {
            "label": "Internal customer email",
            "pattern": r"\b[A-Z0-9._%+-]+@examplecorp\.internal\b",
            "flags": "gi",
            "category": "pii",
            "explanation": "Catches internal customer or employee email addresses for company-specific domains.",
            "placeholder": "<INTERNAL_EMAIL>",
        },
    ],
}


def select_rules(secrets: bool = True, pii: bool = True) -> list[Rule]:
    """The built-in rules of the categories switched on."""
    wanted = {"secret": secrets, "pii": pii}
    return [rule for rule in BUILTIN_RULES if wanted[rule.category]]


def compiles(spark: SparkSession, java_pattern: str) -> bool:
    """Whether Spark accepts the pattern (a local relation: no job runs)."""
    try:
        spark.sql("VALUES ('') AS t(empty)").select(F.col("empty").rlike(java_pattern)).collect()
    except PySparkException:
        return False
    return True


def usable(spark: SparkSession, pattern: str, flags: str) -> str | None:
    """The Java pattern of a user pattern, or None where it is refused."""
    try:
        java = ecmascript.translate(pattern, flags)
    except ecmascript.Refused:
        return None
    return java if compiles(spark, java) else None


def refusal(pattern: str, flags: str | None = None) -> str | None:
    """Why a pattern of one policy is not used, or None; ``operators.patterns.refused`` says it for a table."""
    return ecmascript.reason(pattern, regex.sanitize_flags(flags or "g"))


def custom_rules(spark: SparkSession, patterns: Iterable[Mapping]) -> list[Rule]:
    """Rules for the enabled user patterns; refused ones are left out (:func:`refusal` says why)."""
    rules = []
    for p in patterns:
        flags = regex.sanitize_flags(p["flags"] or "g")
        java = usable(spark, p["pattern"], flags) if p["enabled"] else None
        if java is None:
            continue
        rules.append(
            Rule(
                id=p["id"],
                label=p["label"],
                category=p["category"],
                base=CUSTOM_BASE[p["category"]],
                pattern=p["pattern"],
                flags=flags,
                explanation=p["explanation"] or f'This matches the custom pattern "{p["label"]}".',
                placeholder=p["placeholder"] or default_placeholder(p["label"]),
                gate=prefix_gate(p["pattern"], flags),
                source="custom",
                java=java,
            )
        )
    return rules


def prefix_gate(pattern: str, flags: str) -> Gate:
    """A gate from the literal text the pattern starts with, if it has any."""
    literal = regex.literal_prefix(pattern)
    unicode_case = "i" in flags and ("u" in flags or not pattern.isascii())
    if len(literal) < 3 or unicode_case:
        return NO_GATE
    if "i" in flags:
        return Gate(low=((literal.lower(),),))
    return Gate(exact=((literal,),))


def default_placeholder(label: str) -> str:
    name = "".join(c if c.isascii() and c.isalnum() else " " for c in label.upper())
    return f"<{'_'.join(name.split()) or 'REDACTED'}>"


# Stands in when every category is switched off: it never matches.
NO_RULE = Rule("none", "", "secret", 1, "(?!)", "g", "", "", gate=Gate(pattern="(?!)"))
