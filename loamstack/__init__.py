"""loamstack: consolidation of text memories as DataFrame operators."""
