"""Column builders: expressions that stay inside Spark's JVM plan, plus the
Arrow functions for the steps that need Python."""
