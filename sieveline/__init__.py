"""sieveline: text analytics as Spark plans."""
