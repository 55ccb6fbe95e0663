"""Fixed vocabularies: values that must match printed bank text exactly."""
