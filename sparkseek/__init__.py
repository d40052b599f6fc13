"""sparkseek: search and analytics over keyed documents as PySpark DataFrame plans."""
