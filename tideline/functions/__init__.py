"""Window functions and indicators over bars."""
