"""The rule table against rows written out here, since the SQL of the queries takes its values from the table."""

from given import TESTDATA
from pyspark.sql import functions as F

from leakscan.operators import detect, rules
from leakscan.operators.rules import BUILTIN_RULES
from leakscan.plans import inputs

# Id, label, category, base confidence, placeholder, number of keywords, flags, whether a group is reported.
ROWS = [
    ("openai-key", "OpenAI-style API key", "secret", 84, "<OPENAI_API_KEY>", 6, "g", False),
    ("aws-access-key", "AWS access key", "secret", 86, "<AWS_ACCESS_KEY_ID>", 6, "g", False),
    ("github-token", "GitHub token", "secret", 88, "<GITHUB_TOKEN>", 5, "g", False),
    ("gitlab-token", "GitLab token", "secret", 88, "<GITLAB_TOKEN>", 5, "g", False),
    ("sendgrid-api-key", "SendGrid API key", "secret", 92, "<SENDGRID_API_KEY>", 4, "g", False),
    ("twilio-account-sid", "Twilio Account SID", "secret", 64, "<TWILIO_ACCOUNT_SID>", 3, "g", False),
    ("twilio-api-key-sid", "Twilio API Key SID", "secret", 64, "<TWILIO_API_KEY_SID>", 4, "g", False),
    ("twilio-auth-token", "Twilio auth token", "secret", 90, "<TWILIO_AUTH_TOKEN>", 4, "gi", True),
    ("slack-token", "Slack token", "secret", 88, "<SLACK_TOKEN>", 4, "g", False),
    ("stripe-secret-key", "Stripe secret key", "secret", 88, "<STRIPE_SECRET_KEY>", 4, "g", False),
    ("google-api-key", "Google API key", "secret", 86, "<GOOGLE_API_KEY>", 4, "g", False),
    ("firebase-api-key", "Firebase API key", "secret", 82, "<FIREBASE_API_KEY>", 5, "g", False),
    ("gcp-service-account-private-key-id", "GCP service account private_key_id", "secret", 86, "<GCP_SERVICE_ACCOUNT_PRIVATE_KEY_ID>", 5, "g", True),
    ("gcp-service-account-client-email", "GCP service account client_email", "secret", 82, "<GCP_SERVICE_ACCOUNT_EMAIL>", 6, "gi", True),
    ("jwt", "JWT token", "secret", 82, "<JWT_TOKEN>", 5, "g", False),
    ("pem-private-key", "Private key block", "secret", 99, "<PRIVATE_KEY_BLOCK>", 4, "g", False),
    ("bearer-token", "Bearer token", "secret", 86, "<BEARER_TOKEN>", 4, "gi", True),
    ("auth-header", "Authorization header credential", "secret", 89, "<AUTH_CREDENTIAL>", 5, "gi", True),
    ("env-assignment", "Secret environment variable value", "secret", 92, "<ENV_SECRET>", 5, "gim", True),
    ("connection-string-password", "Connection string password", "secret", 91, "<CONNECTION_PASSWORD>", 6, "gi", True),
    ("azure-storage-connection-string-key", "Azure Storage connection string key", "secret", 92, "<AZURE_STORAGE_ACCOUNT_KEY>", 5, "gi", True),
    ("azure-servicebus-connection-string-key", "Azure Service Bus connection string key", "secret", 92, "<AZURE_SERVICEBUS_SHARED_ACCESS_KEY>", 5, "gi", True),
    ("azure-sas-token-sig", "Azure SAS token signature", "secret", 86, "<AZURE_SAS_SIGNATURE>", 5, "gi", True),
    ("kv-secret-value", "Structured secret value", "secret", 70, "<SECRET_VALUE>", 5, "gim", True),
    ("email", "Email address", "pii", 76, "<EMAIL_ADDRESS>", 4, "gi", False),
    ("phone", "Phone number", "pii", 68, "<PHONE_NUMBER>", 5, "g", False),
]


def test_rules_have_their_values_in_their_order():
    assert [
        (r.id, r.label, r.category, r.base, r.placeholder, len(r.keywords), r.flags, r.captures) for r in BUILTIN_RULES
    ] == ROWS


def test_first_characters_rule_out_no_match(spark, monkeypatch):
    """Every match begins with what is looked for first, in any case that the pattern allows."""
    df = inputs.for_spark(spark, f"{TESTDATA}/sf0.001", "seeded").unionByName(inputs.for_spark(spark, f"{TESTDATA}/sf0.001", "overlaps"))
    df = df.select("doc_id", F.explode(F.array("text", F.upper("text"), F.concat(F.lit("9"), "text", F.lit(" pwd=x")))).alias("text"))

    def found():
        monkeypatch.setattr(detect, "_built", {})
        rows = detect.raw_findings(df).select("doc_id", F.inline("findings")).select("doc_id", "rule_id", "start_pos", "end_pos", "match")
        return sorted(map(tuple, rows.collect()))

    led = found()
    monkeypatch.setattr(rules, "FIRST", {})
    assert led == found() and {r[1] for r in led} == {rule.id for rule in rules.BUILTIN_RULES}
