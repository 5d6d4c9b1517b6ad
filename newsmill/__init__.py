"""newsmill: article-intelligence and corpus operators expressed as Spark DataFrame plans."""
