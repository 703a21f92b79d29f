"""Column functions: text cleaning, predicates, headings, terminology, evidence labels."""
