"""Rules: loading, selection and evaluation."""
