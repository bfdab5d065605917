"""Detection, redaction, policy and incident operators."""
