"""lodeworks: code-base analytics and corpus preparation as PySpark DataFrame programs."""
