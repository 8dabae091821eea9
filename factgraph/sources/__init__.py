"""Sources of facts: stand-ins over driver tables, C# source folders, and snapshot storage."""
