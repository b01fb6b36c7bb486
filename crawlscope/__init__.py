"""Website audits as Spark jobs: recorded crawl tables in, check results, issues and scores out."""
