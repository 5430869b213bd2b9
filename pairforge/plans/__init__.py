"""End-to-end jobs composed of the operators: build, embed, measure, evaluate."""
